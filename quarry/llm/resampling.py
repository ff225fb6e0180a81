"""Target-distribution importance resampling on hashed word n-grams, with each batch's texts in one buffer.

The texts of a batch are joined by a sentinel byte that is in no word; one regular expression finds all words of the
batch in one pass. Places of words against the texts' offsets (searchsorted) tell which text a word is of, and mask the
n-grams that run over two texts before anything is counted. Hashes of n-grams are put together from those of their
words, as a CRC is linear: the CRC of `a b` is that of `a ` moved on by the length of `b`, xor that of `b`.

Two passes read the corpus. The first adds up the buckets of all documents in tasks and then in Spark; the target's are
counted alike. The buckets, whose number is a parameter, give the gains on the driver. The second adds up the gains of
each document. Documents are ranked through one exchange by ranges of their scores.

Defined results: null and empty texts have no words and weight 0; texts of any length are read whole; repeated rows and
repeated ids are drawn each on their own, of equal ones any first; rows without doc_id have no score and aren't drawn;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import texts, written
from quarry.llm.vocabulary import slices

BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: A word in lower-cased UTF-8 (characters beyond ASCII, letters and digits), and all up to the next word.
WORD, REST = rb"[0-9a-z\x80-\xff]+", rb"[^0-9a-z\x80-\xff]*"
FIRST, EACH = re.compile(REST), re.compile(WORD + REST)
#: Bytes that are in no word.
STOPS = bytes(b for b in range(128) if not re.match(WORD, bytes([b])))
SENTINEL = b"\n"
#: A CRC is moved on by up to so many bytes at a time.
TABLED = 128


def moves(steps: int) -> np.ndarray:
    """[L, i, v]: byte i of a CRC with value v, after L further bytes of zeros (without the final xor)."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    out = np.empty((steps, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, steps):
        out[n] = (out[n - 1] >> 8) ^ crc[out[n - 1] & 255]
    return out


_moves: list[np.ndarray] = []


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC as it counts in one of a string that goes on for `length` bytes."""
    if not _moves:
        _moves.append(moves(TABLED).ravel())
    table = _moves[0]
    while True:
        step = np.minimum(length, TABLED - 1)
        at = step.astype(np.int32) << 10
        out = table[at + (crc & 255)]
        for i in (1, 2, 3):
            out ^= table[at + ((crc >> (8 * i)) & 255) + (256 * i)]
        crc, length = out, length - step
        if not length.any():
            return crc


class Features:
    """The features of a batch of texts: the text (by place) and the CRC of each, and how many words each text has."""

    def __init__(self, column: pa.Array, grams: int):
        raw = [x.as_buffer().to_pybytes() for x in column]
        joined = SENTINEL.join(raw).lower()  # A-Z alone
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.cumsum(lengths + 1) - lengths - 1
        at = FIRST.match(joined).end()
        found = EACH.findall(joined, at)
        places = np.cumsum(np.fromiter(map(len, found), np.int32, len(found)), dtype=np.int32) + np.int32(at)
        places = np.concatenate((np.array([at], np.int32), places))
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(places), pa.py_buffer(joined)]).dictionary_encode()
        words = [w.rstrip(STOPS) for w in coded.dictionary.to_pylist()]
        of = coded.indices.to_numpy()
        crcs = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        spaces = moved(crcs, np.ones(len(words), np.int32)) ^ np.uint32(zlib.crc32(b" "))  # of the word and a space
        crc, size, spaced = crcs[of], sizes[of], spaces[of]
        text = np.searchsorted(begins, places[:-1], "right") - 1
        self.words = np.bincount(text, minlength=len(raw))
        self.crcs, self.texts = [crc], [text]
        before = spaced  # of the words and spaces before the last word
        for n in range(2, grams + 1):
            last = slice(n - 1, None)
            inside = text[: max(0, len(text) - n + 1)] == text[last]
            before = before[: max(0, len(crc) - n + 1)]
            self.crcs.append((moved(before, size[last]) ^ crc[last])[inside])
            self.texts.append(text[last][inside])
            if n < grams:
                before = moved(before, size[last] + 1) ^ spaced[last]


def bucket_counts(docs: DataFrame, buckets: int, grams: int) -> np.ndarray:
    """How many features of all texts are in each bucket. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column("text"), 4_000_000):
                for crc in Features(part, grams).crcs:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(there), "n": pa.array(total[there])})

    out = np.zeros(buckets, np.int64)
    whole = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"))
    for r in whole.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more of the target than of the corpus is in each bucket, with one added to each."""
    more = len(s)
    s_all, t_all = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s_all + more) / ((x + 1.0) * (t_all + more)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, grams: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column("text"), 4_000_000):
                found, n = Features(part, grams), len(part)
                weight, features = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for crc, text in zip(found.crcs, found.texts, strict=True):
                    features += np.bincount(text, minlength=n)
                    weight += np.bincount(text, gain[crc % np.uint32(len(gain))], n).astype(np.int64)  # whole numbers under 2^53 are exact
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, n), "n_words": pa.array(found.words.astype(np.int64)), "n_features": pa.array(features), "weight": pa.array(weight)})
                at += n

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, ... for the drawn ones) of each row of docs."""
    gain = gains(bucket_counts(docs, buckets, grams), bucket_counts(target, buckets, grams))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    found = weighted(docs, gain, grams).withColumn("score", score).withColumn("candidate", (F.col("n_words") >= least) & F.col("score").isNotNull())
    # written first, as finding the borders of the ranges reads it once more; one exchange: candidates first, by score; ranges of equal numbers of rows, each sorted in its own task
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("candidate").desc(), F.col("score").desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    placed = written(found, "scored").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("place"))
    placed = written(placed, "ranked")
    sizes = placed.groupBy("part").agg(F.count_if("candidate").alias("n"), F.count_if(F.col("n_words") >= least).alias("long")).collect()  # a row per range
    drawn = sum(r["long"] for r in sizes) * percent // 100
    before, first = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        first.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(first, "part int, before long"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(starts, "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("candidate") & (rank <= drawn), rank).alias("rank"))
