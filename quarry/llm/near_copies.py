"""Near copies by the exact Jaccard similarity of word shingles, found by prefix filtering.

A text is the set of its runs of five words (A-Z lower-cased). Two sets of similarity 0.8 or more share an element
among the first n - ceil(0.8 n) + 1 of each, in any order that all sets follow, and the first one that they share
leaves enough elements after it in both. So all links are found, not most of them. The order puts elements that are
frequent in a sample of the rows last; the sample decides what the search costs, never what it finds. A first round
pairs the sets of each element with the next few of similar size. What that links is one component, so a large group
of near copies isn't paired with itself; a second round takes all pairs of larger groups that are in different
components. Candidates are first checked by the counts of their shingles in 256 classes: two sets share at most the sum
of the lesser counts, so no similar pair is lost. What passes is checked on the shingles of the texts.

Defined results: null and empty texts have no shingles and aren't linked; fewer than five words are one shingle; equal
sets are linked; texts of any length are read whole; of each component exactly one row stays, that of the smallest
doc_id, rows without doc_id last; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SENT_ROWS, drop_path, row_number, steady, texts, without_rows, written
from quarry.llm.components import components
from quarry.llm.simhash import first_rows, runs, shingle_hashes

WORDS = 5
#: The least similarity, as a fraction of whole numbers.
PART, WHOLE = 4, 5
#: About how many rows the order of shingles is made from, in how many of them a frequent one is, and how many are sent to all tasks.
SAMPLE, FREQUENT, SENT = 20_000, 3, 500_000
#: With how many of the next sets of an element a set is paired in the first round.
NEXT = 8
#: About how many sets of a shingle a block of the second round has; how many steps it takes before it gives out what it found.
BLOCK, STEPS = 2000, 256


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The set of the text's shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets is PART / WHOLE or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and WHOLE * both >= PART * (len(a) + len(b) - both)


def class_counts(found: np.ndarray) -> bytes | None:
    """How many elements of a set are in each of 256 classes; None if a byte can't hold a count."""
    count = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else None


def may_be_near(a: list[bytes | None], b: list[bytes | None]) -> np.ndarray:
    """Of pairs of class counts, which can belong to sets of similarity PART / WHOLE or more."""
    known = np.array([x is not None and y is not None for x, y in zip(a, b, strict=True)], bool)
    left, right = (np.frombuffer(b"".join(x for x, k in zip(c, known, strict=True) if k), np.uint8).reshape(-1, 256) for c in (a, b))
    both = np.minimum(left, right).sum(axis=1, dtype=np.int64)
    out = np.ones(len(known), bool)
    out[known] = WHOLE * both >= PART * (left.sum(axis=1, dtype=np.int64) + right.sum(axis=1, dtype=np.int64) - both)
    return out


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in the sample, sorted, and the count of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))})

    share = max(1, docs.count() // SAMPLE)
    seen = texts(docs).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).mapInArrow(run, "shingle long")
    most = seen.groupBy("shingle").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(SENT).toArrow()
    known, count = most["shingle"].to_numpy().view(np.uint64), most["count"].to_numpy()
    order = np.argsort(known)
    return known[order], count[order]


def prefix(found: np.ndarray, known: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The elements of a set that come first, one of which every similar set has among its own first ones."""
    n = len(found)
    often = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        often = np.where(known[at] == found, count[at], 0)
    return found[np.argsort(often, kind="stable")][: n + 1 - -(-PART * n // WHOLE)]


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, row (its number), row_hash of the text, digest of the set (null: it is empty), n (its size), counts (class_counts) and prefix of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = sent.value
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            first = [prefix(x, known, count).view(np.int64) for x in found]
            digest = pa.array([xxhash.xxh64_intdigest(x.tobytes()) - 2**63 if len(x) else None for x in found], pa.int64())
            ends = np.cumsum([0, *map(len, first)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "row_hash": batch.column("row_hash"), "digest": digest, "n": pa.array([len(x) for x in found], pa.int32()), "counts": pa.array([class_counts(x) if len(x) else None for x in found], pa.binary()), "prefix": lists})

    docs = steady(docs)
    return texts(docs, F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("row_hash"), row_number(docs).alias("row")).mapInArrow(run, "doc_id long, row long, row_hash long, digest long, n int, counts binary, prefix array<long>")


def pairs(key: np.ndarray, digest: np.ndarray, n: np.ndarray, pos: np.ndarray, component: np.ndarray | None, steps: range) -> tuple[np.ndarray, np.ndarray]:
    """Places of sets that can be similar by their sizes and the places of the key in them, so many steps apart. The rows are sorted by key and n."""
    at, left, right = np.arange(len(key)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in steps:
        at = at[at + step < len(key)]
        other = at + step
        # rows of a key come by size, so a row that meets a too large one or another key has met all it can
        at = at[(key[at] == key[other]) & (WHOLE * n[at] >= PART * n[other])]
        if not len(at):
            break
        other = at + step
        # both >= PART / (PART + WHOLE) of the sizes' sum, and at most what follows the key in either set
        ok = (PART + WHOLE) * np.minimum(n[at] - pos[at], n[other] - pos[other]) >= PART * (n[at] + n[other])
        ok &= digest[at] != digest[other]
        if component is not None:
            ok &= component[at] != component[other]
        left.append(at[ok])
        right.append(other[ok])
    return np.concatenate(left), np.concatenate(right)


def first_round(postings: DataFrame) -> DataFrame:
    """a, b of candidates; and key, a, n, pos (b is null) of the postings of keys with more sets than the round pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            key, digest, n, pos = (table[c].to_numpy() for c in ("key", "digest", "n", "pos"))
            once = np.concatenate(([True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))  # equal sets of several rows
            key, digest, n, pos = (x[once] for x in (key, digest, n, pos))
            first = np.concatenate(([True], key[1:] != key[:-1]))
            size = np.diff(np.append(np.flatnonzero(first), len(key)))[np.cumsum(first) - 1]
            i, j = pairs(key, digest, n.astype(np.int64), pos.astype(np.int64), None, range(1, NEXT + 1))
            found = np.unique(np.stack((np.minimum(digest[i], digest[j]), np.maximum(digest[i], digest[j])), axis=1), axis=0)
            none = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_pydict({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1]), "key": none(len(found), pa.int64()), "n": none(len(found), pa.int32()), "pos": none(len(found), pa.int32())})
            more = np.flatnonzero(size > NEXT + 1)
            yield pa.RecordBatch.from_pydict({"a": pa.array(digest[more]), "b": none(len(more), pa.int64()), "key": pa.array(key[more]), "n": pa.array(n[more]), "pos": pa.array(pos[more])})

    return postings.repartition("key").sortWithinPartitions("key", "n", "digest").mapInArrow(run, "a long, b long, key long, n int, pos int")


def second_round(postings: DataFrame, roots: DataFrame, told: DataFrame) -> DataFrame:
    """a, b of candidates in different components. postings: key, a, n, pos; roots: id, component; told: digest, counts (class_counts).

    Pairs are checked by their class counts where they meet, so that only those that may be similar are given out.

    Only keys whose sets are in several components go on. Their sets are cut into bands of sizes, two of which can hold
    similar sets if they are neighbours; a band pair of very many sets is cut further into blocks by hash, and each two
    blocks are a task's key of their own. So no task gets a whole frequent shingle, and no pair is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            key, digest, n, pos, component, side = (table[c].to_numpy() for c in ("key", "a", "n", "pos", "component", "side"))
            n, pos, counts = n.astype(np.int64), pos.astype(np.int64), table["counts"].to_pylist()
            for at in range(1, len(key), STEPS):
                i, j = pairs(key, digest, n, pos, component, range(at, min(at + STEPS, len(key))))
                apart = side[i] * side[j] <= 0  # sets of one block meet where it is with itself
                i, j = i[apart], j[apart]
                ok = [may_be_near([counts[k] for k in i[p : p + 5000].tolist()], [counts[k] for k in j[p : p + 5000].tolist()]) for p in range(0, len(i), 5000)]
                ok = np.concatenate([np.zeros(0, bool), *ok])
                i, j = i[ok], j[ok]
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(digest[i], digest[j])), "b": pa.array(np.maximum(digest[i], digest[j]))})
                last = at + STEPS
                if last >= len(key) or not (key[last:] == key[:-last]).any():
                    break

    known = written(postings.join(roots.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")), "known")
    mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    band = F.floor(F.log("n") / float(np.log(WHOLE / PART)) + 1e-9)
    banded = known.join(mixed, "key", "left_semi").withColumn("band", F.explode(F.array(band, band - 1)))
    sizes = banded.groupBy("key", "band").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    dealt = banded.join(sizes, ["key", "band"]).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(-1)
    cell = F.xxhash64("key", "band", F.least("own", "other"), F.greatest("own", "other"))
    ready = dealt.select(cell.alias("key"), "a", "n", "pos", "component", side.cast("int").alias("side")).join(told.withColumnRenamed("digest", "a"), "a")
    return ready.repartition("key").sortWithinPartitions("key", "n", "a").mapInArrow(run, "a long, b long")


def checked(candidates: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidates a, b whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            ok = []
            for a, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                if a != last[0]:
                    last = (a, shingles(text_a))
                ok.append(near(last[1], shingles(text_b)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                yield part.select(["a", "b"]).filter(pa.array(may_be_near(part.column("counts_a").to_pylist(), part.column("counts_b").to_pylist())))

    told = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("counts").alias("counts"))
    counts = lambda c: told.select(F.col("digest").alias(c), F.col("counts").alias(f"counts_{c}"))
    candidates = written(candidates.join(counts("a"), "a").join(counts("b"), "b").select("a", "b", "counts_a", "counts_b").mapInArrow(possible, "a long, b long"), "possible")
    wanted = candidates.select(F.col("a").alias("digest")).union(candidates.select("b")).distinct()
    one = written(rows.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("row_hash").alias("row_hash")), "wanted")
    few = one.count() <= SENT_ROWS
    own = docs.select(F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("row_hash"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = written(own.join(F.broadcast(one) if few else one, "row_hash").dropDuplicates(["digest"]).select("digest", "text"), "texts")
    side = lambda c: found.select(F.col("digest").alias(c), F.col("text").alias(f"text_{c}"))
    return candidates.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """id, component of every set that is linked with another. rows: what prefixes() gives of docs."""
    postings = rows.where("digest IS NOT NULL").select("digest", "n", F.posexplode("prefix").alias("pos", "key"))
    first = written(first_round(postings), "first-round")
    links = written(checked(written(first.where("b IS NOT NULL").select("a", "b").distinct(), "candidates"), rows, docs), "links")
    more = first.where("b IS NULL").select("key", "a", "n", "pos")
    roots = written(components(links), "roots")
    if more.isEmpty():
        drop_path(docs.sparkSession, first)
        return roots
    told = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("counts").alias("counts"))
    again = written(second_round(more, roots, told).distinct(), "candidates")
    drop_path(docs.sparkSession, first)
    if again.isEmpty():
        return roots
    return components(links.union(written(checked(again, rows, docs), "links")))


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, component of each row; no component for rows without shingles."""
    rows = written(prefixes(docs), "prefixes")
    roots = linked(docs, rows).withColumnRenamed("id", "digest")
    return rows.select("doc_id", "row", "digest").join(roots, "digest", "left").select("doc_id", "row", F.coalesce("component", "digest").alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, in all their columns; rows without shingles stay."""
    docs = steady(docs)
    rows = written(components_of(docs), "near-copies")
    own = rows.where("component IS NOT NULL")
    return without_rows(docs, own.select("row").join(first_rows(own, "component"), "row", "left_anti"))
