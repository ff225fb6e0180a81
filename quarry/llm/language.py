"""Language ID with string kernels.

A text is the set of its character n-grams of lengths 1 to 3 (the blended spectrum, by presence), hashed to columns.
The kernel of two texts is the number of n-grams that both have over the root of the product of their numbers. Some
training texts are landmarks; the Nyström map turns kernels with landmarks into features; kernel ridge regression
separates each language from the rest. Many texts are scored by one matrix product with the landmarks and one with
the weights.

N-grams are hashed to COLUMNS numbers, so some share one; a very long text has most of them. Training takes a bounded
sample of rows of each language, all languages included. Defined results: null texts and texts without a letter are `und`
with score 0; without training rows every text is; repeated rows score alike; only text (and for learning doc_id and
lang) is read. Letters are the characters of Unicode's categories L. Texts of any length are read whole, in parts. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.vocabulary import grouped_texts

COLUMNS, LONGEST = 8192, 3
#: The bound of the sample: texts and landmarks of each language, and of all together where there are very many languages. Every language is learned.
SAMPLE, LANDMARKS, ALL_SAMPLE, ALL_LANDMARKS, RIDGE = 500, 32, 100_000, 6400, 1e-3
letter = regex.compile(r"\p{L}")


def presence(texts: list[str]) -> np.ndarray:
    """One row of 0 and 1 per text: which hashed n-grams it has. Texts of any length go through in parts."""
    out = np.zeros((len(texts), COLUMNS), np.float32)
    for row, text in zip(out, texts, strict=True):
        for at in range(0, len(text), 1 << 20):
            c = np.frombuffer(text[at : at + (1 << 20) + LONGEST - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            h = np.zeros(len(c), np.uint32)
            for n in range(1, min(LONGEST, len(c)) + 1):
                h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                row[h & np.uint32(COLUMNS - 1)] = 1
    return out


class Model:
    """Landmarks and one weight vector per language."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, languages: list[str]):
        self.landmarks, self.weights, self.languages = landmarks, weights, languages
        self.sizes = np.sqrt(landmarks.sum(axis=1))

    @staticmethod
    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x @ y.T) / np.maximum(1, np.sqrt(x.sum(axis=1)))[:, None] / np.maximum(1, np.sqrt(y.sum(axis=1)))[None, :]

    @classmethod
    def train(cls, rows: np.ndarray, of: np.ndarray, languages: list[str]) -> Model:
        each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
        chosen = np.concatenate([np.flatnonzero(of == k)[:each] for k in range(len(languages))])
        landmarks = rows[chosen]
        nystrom = cls.nystrom(landmarks)
        return cls(landmarks, (nystrom @ ridge(cls.kernel(rows, landmarks) @ nystrom, of, len(languages))).astype(np.float32), languages)

    @classmethod
    def nystrom(cls, landmarks: np.ndarray) -> np.ndarray:
        """The map from kernels with the landmarks to features whose products are the kernel, on the landmarks' span."""
        values, vectors = np.linalg.eigh(cls.kernel(landmarks, landmarks).astype(np.float64))
        good = values > 1e-6 * values.max()
        return vectors[:, good] / np.sqrt(values[good])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        margins = self.kernel(presence(texts), self.landmarks) @ self.weights
        best = margins.argmax(axis=1)
        odds = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        return [(self.languages[k], float(o[k] / o.sum())) for k, o in zip(best.tolist(), odds, strict=True)]


def ridge(features: np.ndarray, of: np.ndarray, kinds: int) -> np.ndarray:
    """A weight vector for each kind against the rest (1 and -1) by ridge regression. All kinds weigh the same."""
    share = 1 / np.bincount(of, minlength=kinds)[of]
    target = np.where(of[:, None] == np.arange(kinds), 1.0, -1.0)
    weighted = features * share[:, None]
    return np.linalg.solve(weighted.T @ features + RIDGE * np.eye(features.shape[1]), weighted.T @ target)


def held_out(docs: DataFrame) -> F.Column:
    """True for rows whose crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model | None:
    """The model of at most SAMPLE rows (fewer where languages are very many) of each language, those first in the order of a hash of doc_id; None without any."""
    rows = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & ~held_out(docs)).select("doc_id", "lang", F.xxhash64(F.lit("lang"), "doc_id").alias("h"))
    each = max(2, min(SAMPLE, ALL_SAMPLE // max(1, rows.select("lang").distinct().count())))
    ids = rows.withColumn("part", F.pmod("h", F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):  # in two steps, so that a task gets a bounded number of rows of a frequent language
        ids = ids.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).where(F.col("place") <= each).drop("place")
    ids = ids.select("doc_id", F.col("lang").alias("own"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            bits = [np.packbits(presence([t])[0].astype(bool)).tobytes() for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "own": batch.column("own"), "bits": pa.array(bits, pa.binary())})

    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(pack, "doc_id long, own string, bits binary").toArrow()
    packed = sorted(set(zip(found["doc_id"].to_pylist(), found["own"].to_pylist(), map(bytes, found["bits"].to_pylist()), strict=True)))
    names = sorted({x[1] for x in packed})
    if not names:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(x[2] for x in packed), np.uint8).reshape(len(packed), -1), axis=1).astype(np.float32)
    return Model.train(bits, np.array([names.index(x[1]) for x in packed]), names)


def languages(docs: DataFrame, batch_rows: int = 128) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs; held-out rows are not learned from."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found: list[tuple[str, float]] = []
            for group in grouped_texts([t or "" for t in batch.column("text").to_pylist()]):
                for at in range(0, len(group), batch_rows):
                    some = group[at : at + batch_rows]
                    told = model.predict(some) if model else [("und", 0.0)] * len(some)
                    found += [x if letter.search(t) else ("und", 0.0) for x, t in zip(told, some, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

    return docs.select("doc_id", "text", held_out(docs).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
