"""Exact dedup by a minimal perfect hash over the distinct digests of earlier rows.

The earlier rows' distinct digests are split by hash into buckets of bounded size. Each bucket gets a minimal perfect
hash (levels of bits: a digest is placed at the first level where no other one falls on its bit; its slot is the rank
of that bit) whose slots hold the full digest and the winner's locator. Later rows are first reduced to distinct
digests; a lookup compares all bytes of the slot's digest, so a digest that isn't in the history is told for certain,
and such digests form groups of their own.

Defined results: null text counts as empty, and all empty texts are one group. Among equal texts the row with most
code points, then the smallest doc_id stays; a null doc_id loses ties. Rows that repeat a doc_id with an equal text
share its decision in `exact_dedup`; `without_copies` returns exactly one row of each group, in all its columns. Texts
of any length are hashed whole. An empty table gives an empty result. Only doc_id and text are read; other columns may
have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, bucket_count, row_number, steady, without_rows, written

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Digests in a bucket, about.
BUCKET = 50_000


#: Columns of an index: a row per bucket, of so many buckets.
INDEX = "bucket int, buckets int, bits binary, sizes array<int>, slots binary, points array<long>, keep_ids array<long>, rows array<long>, counts array<long>"


class PerfectHash:
    """Slots 0 to n-1 for n distinct digests."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(x) - 1 for x in levels]
        self.first = np.concatenate(([0], np.cumsum([int(x.sum()) for x in levels])))

    @staticmethod
    def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 1))) * MIX
        return ((mixed >> np.uint64(20)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels = []
        while len(words):
            if len(levels) == 64:
                raise ValueError("equal digests can't have slots of their own")
            at = cls.place(words, len(levels), size := max(8, 2 * len(words)))
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            words = words[~bits[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 or any slot for one that was not in the set."""
        out, todo = np.full(len(words), -1), np.arange(len(words))
        for k, bits in enumerate(self.levels):
            at = self.place(words[todo], k, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.first[k] + self.ranks[k][at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @classmethod
    def load(cls, raw: bytes, sizes: list[int]) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            end = at + -(-n // 8)
            levels.append(np.unpackbits(np.frombuffer(raw[at:end], np.uint8), count=n).astype(bool))
            at = end
        return cls(levels)


def as_words(digests: pa.ChunkedArray) -> np.ndarray:
    """Binary digests of 32 bytes as rows of four numbers."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (its number), digest (SHA-256 of the text without white space), points (code points of the text)."""
    docs = steady(docs)
    t = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), row_number(docs).alias("row"))
    return t.select("doc_id", "row", F.unhex(F.sha2(F.translate("text", SPACES, ""), 256)).alias("digest"), F.length("text").cast("long").alias("points"))


def classes(rows: DataFrame) -> DataFrame:
    """One row per digest: points, keep_id and row of the row that stays, size. Bits are turned around for the order from high to low."""
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))).alias("best")
    return rows.groupBy("digest").agg(best, F.count("*").alias("size")).select("digest", F.col("best.points").alias("points"), F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.row").alias("row"), "size")


def bucketed(classes_: DataFrame, buckets: int) -> DataFrame:
    return classes_.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """A row per bucket: the hash's bits and, in slot order, the full digests and what is known of each winner."""

    def build(group: pa.Table) -> pa.Table:
        words = as_words(group["digest"])
        made = PerfectHash.build(words)
        order = np.argsort(made.slots(words))
        raw, sizes = made.dump()
        of = lambda name: [group[name].take(pa.array(order)).to_pylist()]
        return pa.table({"bucket": pa.array([group["bucket"][0].as_py()], pa.int32()), "buckets": pa.array([buckets], pa.int32()), "bits": [raw], "sizes": pa.array([sizes], pa.list_(pa.int32())), "slots": [words[order].tobytes()], "points": pa.array(of("points"), pa.list_(pa.int64())), "keep_ids": pa.array(of("keep_id"), pa.list_(pa.int64())), "rows": pa.array(of("row"), pa.list_(pa.int64())), "counts": pa.array(of("size"), pa.list_(pa.int64()))})

    return bucketed(history, buckets).groupBy("bucket").applyInArrow(build, INDEX)


def look_up(index: DataFrame, arrivals: DataFrame, buckets: int) -> DataFrame:
    """Every class of the index and of the arrivals together: digest, keep_id, row (of the row that stays), group_size, in_history."""

    def probe(held: pa.Table, new: pa.Table) -> pa.Table:
        n = new.num_rows
        words = as_words(new["digest"]) if n else np.zeros((0, 4), np.uint64)
        points, keep, row, size = (new[c].to_pylist() if n else [] for c in ("points", "keep_id", "row", "size"))
        if not held.num_rows:
            return table(words, keep, row, size, [False] * n)
        slots = np.frombuffer(held["slots"][0].as_py(), "<u8").reshape(-1, 4)
        at = PerfectHash.load(held["bits"][0].as_py(), held["sizes"][0].as_py()).slots(words)
        member = (at >= 0) & (slots[at] == words).all(axis=1)
        best_points, best_keep, best_row, counts = (held[c][0].as_py() for c in ("points", "keep_ids", "rows", "counts"))
        better = lambda p, k, r: (p, k is not None, -(k or 0), -r)
        for i in np.flatnonzero(member).tolist():
            s = at[i]
            counts[s] += size[i]
            if better(points[i], keep[i], row[i]) > better(best_points[s], best_keep[s], best_row[s]):
                best_points[s], best_keep[s], best_row[s] = points[i], keep[i], row[i]
        alone = np.flatnonzero(~member).tolist()
        pick = lambda values: [values[i] for i in alone]
        return pa.concat_tables([table(slots, best_keep, best_row, counts, [True] * len(slots)), table(words[~member], pick(keep), pick(row), pick(size), [False] * len(alone))])

    def table(words: np.ndarray, keep: list, row: list, size: list, known: list) -> pa.Table:
        return pa.table({"digest": pa.array([w.tobytes() for w in words], pa.binary()), "keep_id": pa.array(keep, pa.int64()), "row": pa.array(row, pa.int64()), "group_size": pa.array(size, pa.int64()), "in_history": pa.array(known, pa.bool_())})

    return index.groupBy("bucket").cogroup(bucketed(arrivals, buckets).groupBy("bucket")).applyInArrow(probe, "digest binary, keep_id long, row long, group_size long, in_history boolean")


def decided(docs: DataFrame, historical: Column) -> tuple[DataFrame, DataFrame]:
    """The digest rows of docs, and the class of each digest. historical: true for rows that came in earlier (of doc_id)."""
    rows = written(digests(docs), "digests")
    buckets = bucket_count(docs.sparkSession, rows.count(), BUCKET)
    earlier = F.coalesce(historical, F.lit(False))
    index = build_index(classes(rows.where(earlier)), buckets)
    return rows, look_up(index, classes(rows.where(~earlier)), buckets)


def exact_dedup(docs: DataFrame, historical: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history of each row."""
    rows, found = decided(docs, historical)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.drop("row").join(found.drop("row"), "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history")


def without_copies(docs: DataFrame, historical: Column) -> DataFrame:
    """docs with one row of each group of equal texts, in all its columns. Only numbers of rows are shuffled."""
    docs = steady(docs)
    rows, found = decided(docs, historical)
    return without_rows(docs, rows.select("row").join(found.select("row"), "row", "left_anti"))


def save_index(docs: DataFrame, path: str) -> None:
    """Writes the index of all rows of docs, for later runs to look up."""
    buckets = bucket_count(docs.sparkSession, docs.count(), BUCKET)
    build_index(classes(written(digests(docs), "digests")), buckets).write.parquet(path)


def known_before(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text_sha256, known (whether a text equal to it is in the saved index), known_as (doc_id of the row that stays there), of each row of docs."""
    spark = docs.sparkSession
    index = spark.read.schema(INDEX).parquet(path)
    held = index.agg(F.max("buckets")).first()[0]
    rows = written(digests(docs), "digests")
    if held is None:
        return rows.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), F.lit(False).alias("known"), F.lit(None).cast("long").alias("known_as"))

    def probe(held: pa.Table, new: pa.Table) -> pa.Table:
        keep = pa.array([], pa.int64())
        member = np.zeros(new.num_rows, bool)
        if held.num_rows and new.num_rows:
            words, slots = as_words(new["digest"]), np.frombuffer(held["slots"][0].as_py(), "<u8").reshape(-1, 4)
            at = PerfectHash.load(held["bits"][0].as_py(), held["sizes"][0].as_py()).slots(words)
            member = (at >= 0) & (slots[at] == words).all(axis=1)
            keep = pa.array(held["keep_ids"][0].as_py(), pa.int64()).take(pa.array(at[member]))
        return pa.table({"digest": new["digest"].combine_chunks().filter(pa.array(member)) if new.num_rows else pa.array([], pa.binary()), "known_as": keep})

    found = index.groupBy("bucket").cogroup(bucketed(rows.select("digest").distinct(), held).groupBy("bucket")).applyInArrow(probe, "digest binary, known_as long")
    return rows.join(found.withColumn("known", F.lit(True)), "digest", "left").select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), F.coalesce("known", F.lit(False)).alias("known"), "known_as")


def middle_id(docs: DataFrame) -> Column:
    """True for the lower half of the doc_ids: what came in earlier, where ids are given in order."""
    cut = docs.select(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    return F.col("doc_id") <= F.lit(cut)
