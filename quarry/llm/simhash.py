"""SimHash fingerprints and their links, found by pigeonring filtering.

The 64 bits lie in five segments on a ring. If two fingerprints differ in at most 2 bits, some chain of consecutive
segments keeps every prefix of length l within the proportional budget l*2/5 of differing bits: the first two
segments are equal, then at most 1 difference in three and in four, then 2 in all. So fingerprints meet only under an
equal pair of consecutive segments (about 26 bits); the rest of the chain prunes them before the full count. A pair of
segments that many different fingerprints share is split again by the same rule on the other 38 bits, so that no task
gets a large group, and links are not lost; groups of that second split are searched in tiles of bounded size. Of each
group only a spanning forest of the links is kept, which has the same components as all links.

Defined results: null and empty texts have fingerprint zero and are linked like any other; fewer than three words are
one shingle; texts of any length are read whole; repeated rows and ties count as often as they stand there; an empty
table gives an empty result; only doc_id and text are read. Rows without doc_id are linked like others; a component of
such rows alone has no component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import row_number, steady, texts, without_rows, written
from quarry.llm.components import components
from quarry.llm.vocabulary import grouped_texts

#: Bits of the ring's segments, from the lowest, and of the segments of the 38 bits that are left beside a pair.
SEGMENTS = (13, 13, 13, 13, 12)
DIFFERENCES = 2
#: A pair of segments that more fingerprints share is split again.
SHARED = 1000


def ring(bits: list[int], sizes: tuple[int, ...]) -> list[list[int]]:
    """The bits as consecutive segments."""
    out, at = [], 0
    for n in sizes:
        out.append(bits[at : at + n])
        at += n
    return out


def mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def thirds(bits: list[int]) -> list[list[int]]:
    return ring(bits, tuple(len(bits) // 5 + (k < len(bits) % 5) for k in range(5)))


RING = ring([*range(64)], SEGMENTS)
#: For each start on the ring: the masks of the chain's growing prefixes and how many differences each may have.
CHAINS = [[(mask([b for k in range(n) for b in RING[(s + k) % 5]]), n * DIFFERENCES // 5) for n in range(2, 6)] for s in range(5)]


def shingle_hashes(text: str, words: int = 3) -> list[int]:
    """XXH64 with seed 42 of each run of `words` words, A-Z lower-cased; fewer words are one run."""
    parts = text.encode("utf-8").lower().split()
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), 42)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words]))
    return list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts.tolist(), (ends[words - 1 :] - 1).tolist())), repeat(42)))


def fingerprints_of(group: list[str], words: int = 3) -> np.ndarray:
    """The fingerprint of each text."""
    out = np.zeros(len(group), np.uint64)
    for i, text in enumerate(group):
        hashes = np.array(shingle_hashes(text, words), np.uint64)
        total = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 20_000):
            total += np.unpackbits(hashes[at : at + 20_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, row (its number), fp (the fingerprint as a signed number) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(group, words) for group in grouped_texts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "fp": pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))})

    docs = steady(docs)
    return texts(docs, row_number(docs).alias("row")).mapInArrow(run, "doc_id long, row long, fp long")


def forest(fps: np.ndarray, ids: np.ndarray, chain: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest among fingerprints with an equal key: pairs that pass the chain's budgets."""
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, 2_000_000 // n)
    for at in range(0, n - 1, step):
        rows = np.arange(at, min(n - 1, at + step))
        differ = fps[rows][:, None] ^ fps[None, :]
        ok = np.arange(n)[None, :] > rows[:, None]
        for bits, most in chain:  # the budgets in turn, each over what the last one left
            ok &= np.bitwise_count(differ & np.uint64(bits)) <= most
        for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
            a, b = find(rows[i]), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield int(ids[rows[i]]), int(ids[j])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a task in tables that hold every key's rows whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def linked(postings: DataFrame) -> DataFrame:
    """a, b: links among the fingerprints of each key. postings: key long, start int (on the ring), fp, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            key, start, fp, ids = (table[c].to_numpy() for c in ("key", "start", "fp", "id"))
            ends = np.flatnonzero(np.concatenate((np.diff(key) != 0, [True]))) + 1
            begins = np.concatenate(([0], ends[:-1]))
            links = [x for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b - a > 1 for x in forest(fp[a:b].view(np.uint64), ids[a:b], CHAINS[start[a]])]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return postings.select("key", "start", "fp", "id").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """a, b: ids of different fingerprints that differ in at most 2 bits, enough to connect what is connected. distinct: fp, id."""
    part = lambda bits, s: F.xxhash64(F.lit(s), F.col("fp").bitwiseAND(F.lit(signed(mask(bits)))))
    starts = F.array(*[F.struct(F.lit(s).alias("start"), part(RING[s] + RING[(s + 1) % 5], s).alias("key")) for s in range(5)])
    postings = written(distinct.select("fp", "id", F.explode(starts).alias("p")).select("fp", "id", "p.start", "p.key"), "postings")
    shared = postings.groupBy("key").count().where("count > 1")
    keyed = postings.join(shared, "key")
    finer = []
    for s in range(5):
        rest = thirds([b for k in range(2, 5) for b in RING[(s + k) % 5]])
        own = [F.xxhash64("key", F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(mask(rest[t] + rest[(t + 1) % 5]))))) for t in range(5)]
        finer.append(keyed.where((F.col("start") == s) & (F.col("count") > SHARED)).select("fp", "id", "start", F.explode(F.array(*own)).alias("key")))
    cold = keyed.where(F.col("count") <= SHARED).select("fp", "id", "start", "key")
    for x in finer:
        cold = cold.unionByName(x)
    return linked(cold)


def components_of(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, row, fp, component (smallest fingerprint reachable, as a signed number) of each row."""
    rows = written(fingerprints(docs, words), "fingerprints")
    distinct = written(rows.select("fp").distinct().select("fp", F.col("fp").alias("id")), "distinct")
    roots = components(written(links(distinct), "links"))
    return rows.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("doc_id", "row", "fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of each row."""
    rows = written(components_of(docs, words), "components")
    named = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "component").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """row of the row of each key that stays: the one with the smallest doc_id, rows without doc_id last. rows: key, doc_id, row."""
    best = F.max(F.struct(F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))).alias("best")
    return rows.groupBy(key).agg(best).select(F.bitwise_not("best.row").alias("row"))


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs with one row of each component, in all its columns."""
    docs = steady(docs)
    rows = written(components_of(docs, words), "components")
    return without_rows(docs, rows.select("row").join(first_rows(rows, "component"), "row", "left_anti"))
