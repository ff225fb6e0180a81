"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes, with marks at both ends, hashed) and of itself, so an unseen misspelling
shares vectors with the words that it resembles. Embeddings and softmax are trained together in numpy. Words are
averaged over short overlapping windows, and a text scores as its most toxic window, so that one passage in a very
long text isn't averaged away. Training takes windows of a bounded sample of labelled rows. N-grams that are as common
in toxic texts as in others keep a zero vector; in a second round the windows of toxic texts that the first model
finds harmless no longer count as toxic. Last, the most toxic windows of the sample's whole texts are calibrated by a
logistic curve, so that the many windows of a long text don't add up to a verdict.

Defined results: null and empty texts score 0; rows without a label are scored, not learned from; repeated rows score
alike; without labels of both kinds all texts score 0; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import texts, written
from quarry.llm.vocabulary import Kept, grouped_texts

BITS, DIMENSIONS, DECAY = 18, 8, 1e-6
#: An n-gram has a vector if its share of texts differs by this factor between the kinds, with a likelihood ratio
#: statistic that chance hardly reaches in any of 2^18 buckets.
FACTOR, EVIDENCE = 2.5, 27.0
WINDOW, STRIDE = 16, 8
#: The bound of the sample: toxic and other labelled texts. All windows of each are learned from.
SAMPLE = (2000, 6000)


#: Odd numbers by which bytes are weighed, by place, in the hash of a whole word.
PLACES = np.random.default_rng(11).integers(0, 2**31, 4096).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def held_out(docs: DataFrame) -> F.Column:
    """True for rows whose crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of the words, one word after the other, and how many each word has (at least one)."""
    raw = b"".join(b"\xff" + w + b"\xfe" for w in words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(b))
    values, owners = [], []
    h = np.zeros(len(b), np.uint32)
    word = np.repeat(np.arange(len(words)), lengths)
    for n in range(1, 6):
        m = len(b) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(16777619) ^ b[n - 1 :]
        if n >= 3:
            ok = left[:m] >= n
            values.append(((h[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64))
            owners.append(word[:m][ok])
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.add.reduceat((b + np.uint32(1)) * PLACES[(lengths.repeat(lengths) - left) % len(PLACES)], np.cumsum(lengths) - lengths).astype(np.uint32)
    values.append(((whole * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int64))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(values)[order], np.bincount(owner, minlength=len(words))


def window_starts(n: int) -> np.ndarray:
    """Where windows start so that each word of n is in one, two for most."""
    return np.append(np.arange(0, max(0, n - WINDOW), STRIDE), max(0, n - WINDOW))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted. Sorting is faster here than the hash table of np.unique."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


class Sums:
    """Adds rows of one table up in rows of another, as links from `source` to `at` say. The links are sorted once."""

    def __init__(self, source: np.ndarray, at: np.ndarray, rows: int):
        order = np.argsort(at, kind="stable")
        self.source, self.rows = source[order], rows
        self.present, self.starts = np.unique(at[order], return_index=True)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, values.shape[1]))
        if len(self.starts):
            out[self.present] = np.add.reduceat(values[self.source], self.starts, axis=0)
        return out


class Windows:
    """The sample's windows: distinct words with their n-grams, and the words, kind and text of each window.

    Words are kept as numbers and hashed in parts, so that the sample takes little memory.
    """

    def __init__(self, rows: Iterable[tuple[int, int, bytes]]):
        """rows: doc_id, toxic and the words of each text, which is cut into its windows here; equal windows of a text count once."""
        known: dict[bytes, int] = {}
        size, word, toxic, doc = ([] for _ in range(4))
        for own, kind, raw in rows:
            ids = np.fromiter((known.setdefault(w, len(known)) for w in raw.split()), np.int32)
            if not len(ids):
                continue
            cut = np.unique(np.lib.stride_tricks.sliding_window_view(ids, min(WINDOW, len(ids)))[window_starts(len(ids))], axis=0)
            size.append(np.full(len(cut), cut.shape[1]))
            word.append(cut.ravel())
            toxic.append(np.full(len(cut), kind))
            if not doc or doc[-1][0] != own:
                number = doc[-1][1] + 1 if doc else 0
            doc.append((own, number, len(cut)))
        joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts], dtype=kind, casting="unsafe")
        self.size, self.word, self.toxic = joined(size, np.int32), joined(word, np.int32), joined(toxic, np.int32)
        #: The place of each window's text, rising: texts of one doc_id are one.
        self.doc = np.repeat(np.array([x[1] for x in doc], np.int32), [x[2] for x in doc])
        word.clear()
        words, buckets, counts = list(known), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 20_000):
            bucket, per_word = grams(words[at : at + 20_000])
            buckets.append(bucket.astype(np.int32))
            counts.append(per_word)
        self.bucket, self.per_word = np.concatenate(buckets), np.concatenate(counts)

    def contexts(self, part: int = 50_000) -> np.ndarray:
        """In how many different words after different words of toxic texts each n-gram occurs: copies of a text add none."""
        own, size = self.word[np.repeat(self.toxic == 1, self.size)], self.size[self.toxic == 1]
        before = np.concatenate(([-1], own[:-1])).astype(np.int64)
        before[np.cumsum(size, dtype=np.int64)[:-1]] = -1
        word = distinct((before[: len(own)] + 1) << 32 | own) & (2**32 - 1)
        first, out = np.cumsum(self.per_word) - self.per_word, np.zeros(1 << BITS)
        for at in range(0, len(word), part):
            own = word[at : at + part]
            size = self.per_word[own]
            ends = np.cumsum(size)
            inside = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(first[own], size)
            pairs = distinct(np.repeat(np.arange(len(own)), size) << BITS | self.bucket[inside])
            out += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
        return out

    def telling(self, docs: int = 200) -> np.ndarray:
        """bucket -> row of its vector, -1 for n-grams that are about as common in both kinds of text."""
        kind = np.zeros(int(self.doc.max()) + 1, np.int64)
        kind[self.doc] = self.toxic
        n = np.bincount(kind, minlength=2).astype(float)
        seen = np.zeros((2, 1 << BITS))
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.size, dtype=np.int64)))
        edges = np.searchsorted(self.doc, np.arange(0, len(kind) + docs, docs))  # of windows
        first = np.cumsum(self.per_word) - self.per_word
        for a, b in zip(edges, edges[1:], strict=False):
            pairs = distinct(np.repeat(self.doc[a:b].astype(np.int64), self.size[a:b]) << 32 | self.word[ends[a] : ends[b]])
            of, word = pairs >> 32, pairs & (2**32 - 1)
            size = self.per_word[word]
            upto = np.cumsum(size)
            inside = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size, size) + np.repeat(first[word], size)
            pairs = distinct(np.repeat(of, size) << BITS | self.bucket[inside])
            for k in (0, 1):
                seen[k] += np.bincount(pairs[kind[pairs >> BITS] == k] & ((1 << BITS) - 1), minlength=1 << BITS)
        good, bad = seen[0], np.minimum(seen[1], self.contexts())
        p, q = (bad + 0.5) / (n[1] + 1), (good + 0.5) / (n[0] + 1)
        term = lambda k, m: k * np.log(np.maximum(k, 1) / np.maximum((bad + good) * m / n.sum(), 1e-9))
        chosen = (np.maximum(p / q, q / p) >= FACTOR) & (2 * (term(bad, n[1]) + term(good, n[0])) >= EVIDENCE)
        return np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32)


class Task:
    """Loss and gradients of the softmax over the averages of the kept windows; both kinds weigh the same.

    Windows without a word that has a vector are all alike, so they count as one of each kind with their joint weight.
    """

    def __init__(self, index: np.ndarray, sample: Windows, keep: np.ndarray):
        gram = index[sample.bucket]
        owner = np.repeat(np.arange(len(sample.per_word), dtype=np.int32), sample.per_word)[gram >= 0]
        gram = gram[gram >= 0]
        has = np.zeros(len(sample.per_word), bool)
        has[owner] = True
        used = has[sample.word] & np.repeat(keep, sample.size)
        window = np.repeat(np.arange(len(sample.size), dtype=np.int32), sample.size)[used]
        # words with a vector that stand in a kept window
        seen, word = np.unique(sample.word[used], return_inverse=True)
        stays = np.isin(owner, seen)
        owner, gram = np.searchsorted(seen, owner[stays]), gram[stays]
        active, window = np.unique(window, return_inverse=True)
        size, toxic = sample.size[active], sample.toxic[active]
        share = 0.5 / np.maximum(1, np.bincount(sample.toxic[keep], minlength=2))
        rest = np.bincount(sample.toxic[keep], minlength=2) - np.bincount(sample.toxic[active], minlength=2)
        # windows of the same words with vectors (told by sums of random numbers), size and kind count as one with their joint weight
        sign = np.random.default_rng(5).integers(0, 2**63, len(seen), dtype=np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1]))) if len(window) else np.zeros(0, np.int64)
        key = np.add.reduceat(sign[word], starts) * np.uint64(64) + (2 * size + toxic).astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        stays = np.zeros(len(active), bool)
        stays[first] = True
        word, window = word[stays[window]], of[window[stays[window]]]
        self.share = np.append(np.bincount(of, share[toxic], len(first)), rest * share)
        self.size = np.append(size[first], (1, 1))[:, None]
        self.target = np.eye(2)[np.append(toxic[first], (0, 1))]
        self.per_word = sample.per_word[seen][:, None]
        self.to_words, self.to_windows = Sums(gram, owner, len(seen)), Sums(word, window, len(self.target))
        self.back_to_words, self.back_to_grams = Sums(window, word, len(seen)), Sums(owner, gram, int(index.max()) + 1)

    def averages(self, e: np.ndarray) -> np.ndarray:
        return self.to_windows(self.to_words(e) / self.per_word) / self.size

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def loss(self, e: np.ndarray, w: np.ndarray, b: np.ndarray) -> float:
        p = self.softmax(self.averages(e) @ w + b)
        return float(-(self.share * np.log((p * self.target).sum(axis=1))).sum() + DECAY / 2 * (e * e).sum())

    def gradients(self, e: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.averages(e)
        d = (self.softmax(x @ w + b) - self.target) * self.share[:, None]
        dv = self.back_to_words((d @ w.T) / self.size) / self.per_word
        return self.back_to_grams(dv) + DECAY * e, x.T @ d, d.sum(axis=0)


class Model:
    """Embeddings of the n-grams in `index` (bucket to row, -1: a zero vector) and a softmax over their averages."""

    def __init__(self, index: np.ndarray, embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.index, self.embeddings, self.weights, self.bias = index, embeddings, weights, bias
        self.slope, self.shift = 1.0, float(bias[1] - bias[0])

    @classmethod
    def train(cls, index: np.ndarray, sample: Windows, keep: np.ndarray, epochs: int = 150, seed: int = 7) -> Model:
        """The model of the windows that are kept."""
        rng = np.random.default_rng(seed)
        task = Task(index, sample, keep)
        e = rng.normal(0, 0.1, (int(index.max()) + 1, DIMENSIONS))
        w, b = rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, w, b)]
        for t in range(1, epochs + 1):
            for value, grad, (m, v) in zip((e, w, b), task.gradients(e, w, b), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        return cls(index, e, w, b)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to a window's margin: its embedding times the softmax's weights."""
        bucket, per_word = grams(words)
        margin = np.append(self.embeddings @ (self.weights[:, 1] - self.weights[:, 0]), 0.0)[self.index[bucket]]
        return np.bincount(np.repeat(np.arange(len(words)), per_word), margin, len(words)) / np.maximum(per_word, 1)

    def window_margins(self, sample: Windows) -> np.ndarray:
        """The mean score of each window's words."""
        value = np.append(self.embeddings @ (self.weights[:, 1] - self.weights[:, 0]), 0.0)
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sample.per_word)))
        words = np.empty(len(sample.per_word))
        for at in range(0, len(words), 20_000):  # each word has an n-gram at least
            to = min(at + 20_000, len(words))
            words[at:to] = np.add.reduceat(value[self.index[sample.bucket[ends[at] : ends[to]]]], ends[at:to] - ends[at])
        words /= sample.per_word
        return np.add.reduceat(words[sample.word], np.cumsum(sample.size, dtype=np.int64) - sample.size) / sample.size

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))

    def calibrate(self, margin: np.ndarray, toxic: np.ndarray, steps: int = 2000) -> None:
        """Slope and shift of the curve from margins of whole texts; both kinds weigh the same."""
        scale = float(np.abs(margin).mean()) + 1e-9
        x, share = np.clip(margin / scale, -20, 20), np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
        a, c = 1.0, 0.0
        for _ in range(steps):
            d = (1 / (1 + np.exp(-np.clip(a * x + c, -50, 50))) - toxic) * share
            a, c = max(1e-3, a - 2 * (float(d @ x) + 1e-4 * a)), c - 2 * float(d.sum())
        self.slope, self.shift = a / scale, c


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic of at most SAMPLE labelled texts of the two kinds that aren't held out: those first in the order of a hash."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    known = known.where(~held_out(known)).withColumn("h", F.xxhash64(F.lit("toxic"), "doc_id"))
    return known.where("toxic = 1").orderBy("h", "doc_id").limit(SAMPLE[0]).union(known.where("toxic = 0").orderBy("h", "doc_id").limit(SAMPLE[1])).select("doc_id", "toxic")


def sampled_texts(chosen: DataFrame) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, toxic, words) of the sample's different texts, in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": pa.array(words, pa.binary())})

    found = chosen.mapInArrow(cut, "doc_id long, toxic int, words binary").distinct().orderBy("doc_id", "toxic", "words").toArrow()
    for batch in found.to_batches(200):
        yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "words")), strict=True)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the sample; None without both kinds of label or without a telling n-gram."""
    chosen = written(texts(docs).join(F.broadcast(sample(docs, labels)), "doc_id"), "sample")
    windows = Windows(sampled_texts(chosen))
    if not len(windows.toxic) or windows.toxic.min() == windows.toxic.max():
        return None
    index = windows.telling()
    if index.max() < 0:
        return None
    model = Model.train(index, windows, np.ones(len(windows.toxic), bool))
    keep = (windows.toxic == 0) | (model.probability(model.window_margins(windows)) >= 0.5)
    if (windows.toxic[keep] == 1).any():
        model = Model.train(index, windows, keep)
    whole = margins(chosen, model, "toxic").toArrow()
    model.calibrate(whole["margin"].to_numpy(), whole["toxic"].to_numpy())
    return model


def scorer(model: Model | None) -> Callable[[list[str]], list[float | None]]:
    """A function that gives the margin of each text's most toxic window; None for texts without words."""
    kept = Kept(lambda words: model.word_scores(words).tolist())

    def score(batch: list[str]) -> list[float | None]:
        found: list[float | None] = []
        for group in grouped_texts(batch):
            cut = [words_of(t) if model else [] for t in group]
            if model:
                kept.cover(set(chain.from_iterable(cut)))
            found += [most_toxic(np.fromiter(map(kept.__getitem__, words), np.float64, len(words))) if words else None for words in cut]
        return found

    return score


def margins(rows: DataFrame, model: Model | None, *more: str) -> DataFrame:
    """doc_id, the margin of each text's most toxic window (null: none), and other named columns."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "margin": pa.array(score(batch.column("text").to_pylist()), pa.float64())} | {c: batch.column(c) for c in more})

    kinds = dict(rows.dtypes)
    return rows.select("doc_id", "text", *more).mapInArrow(run, ", ".join(["doc_id long", "margin double", *(f"{c} {kinds[c]}" for c in more)]))


def most_toxic(words: np.ndarray) -> float:
    """The largest mean of a window."""
    total = np.concatenate(([0.0], np.cumsum(words)))
    starts = window_starts(len(words))
    ends = np.minimum(starts + WINDOW, len(words))
    return float(((total[ends] - total[starts]) / (ends - starts)).max())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs. Labels of held-out rows are never read."""
    model = fit(docs, labels)
    rows = margins(texts(docs, held_out(docs).alias("held_out")), model, "held_out")
    slope, shift = (model.slope, model.shift) if model else (0.0, 0.0)
    score = F.coalesce(1 / (1 + F.exp(-(F.col("margin") * slope + shift))), F.lit(0.0))
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic, in all their columns. Rows are judged where they are read, so none is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        score = scorer(model)
        for batch in batches:
            found = score([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([m is None or float(model.probability(np.float64(m))) < 0.5 for m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
