"""Repeated byte strings by a common-prefix interval tree over an enhanced suffix array, in groups that Spark deals out.

Every window of SHORT bytes has an anchor: its leftmost GRAM bytes of least hash. Equal windows have equal anchors at
equal places, so windows are grouped by their anchors' hashes, one context (the bytes of all windows of one anchor, and
what follows them up to LENGTH bytes from the last one's start) per anchor. A string of LENGTH bytes lies whole in the
context of its first window. Contexts that are equal as a whole, by a 16-byte BLAKE2 digest of their bytes, are repeats
in whole. Of the others, one of each kind is brought to the group of its anchor, where the suffixes from the anchor on
are sorted, a stack scan over their common prefixes gives the tree of intervals, and each interval is tested for the
diversity of its left extensions: runs of contexts that also share enough to the left are maximal repeats, with all
their occurrences. A group of very many different contexts is counted by all its windows instead, with partial sums
before the shuffle, so no task gets an unbounded group; that gives the same bytes.

Repeats of LENGTH bytes are removed. Shorter ones, of SHORT bytes or more, are only told: a passage is a repeat of over
WORDS words that stands in another row too.

Defined results: null texts are empty; texts under LENGTH bytes lose nothing; texts of any length are read whole, in
pieces; repeated rows are repeats of each other; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_path, row_number, steady, written
from quarry.llm.simhash import runs

LENGTH, SHORT, GRAM, WORDS = 400, 256, 32, 50
#: An anchor with more different contexts is counted by windows.
SHARED = 10_000
PLACE_BITS = np.uint64(24)
PIECE = 1 << 22
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` (a multiple of 8) bytes from each place on."""
    n = len(b) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        words = np.ndarray((n,), "<u8", b, 8 * k, (1,))
        h += (words ^ (words >> np.uint64(29))) * ODD[k % 4]
    h ^= h >> np.uint64(32)
    h *= ODD[3]
    return h ^ (h >> np.uint64(29))


def contexts_of(raw: bytes, length: int = LENGTH, gram: int = GRAM, short: int = SHORT) -> tuple[np.ndarray, ...]:
    """key (hash of the anchor), low, place, high, end of each context of a text: first window, anchor, last window, end of its bytes."""
    parts = [[] for _ in range(4)]
    short = min(short, length)
    for at in range(0, max(0, len(raw) - short + 1), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + short - 1], np.uint8)
        h = gram_hashes(b, gram)
        least = (h & ~((np.uint64(1) << PLACE_BITS) - np.uint64(1))) | np.arange(len(h), dtype=np.uint64)
        width, reach = short - gram + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        place = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        low = np.flatnonzero(np.concatenate(([True], np.diff(place) != 0)))
        high = np.append(low[1:], len(place)) - 1
        for part, x in zip(parts, (h[place[low]], low + at, place[low] + at, high + at), strict=True):
            part.append(x)
    key, low, place, high = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
    return key, low, place, high, np.minimum(high + length, len(raw))


def keyed(docs: DataFrame) -> DataFrame:
    """row (its number), doc_id and raw (the bytes of the text)."""
    return docs.select(row_number(docs).alias("row"), "doc_id", F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8").alias("raw"))


def segments(rows: DataFrame, length: int, gram: int, short: int) -> DataFrame:
    """The contexts of all rows, without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, whole = [], []
            for x in batch.column("raw"):
                raw = x.as_buffer().to_pybytes()
                found.append(own := contexts_of(raw, length, gram, short))
                whole += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(own[1].tolist(), own[4].tolist(), strict=True)]
            size = [len(f[0]) for f in found]
            col = lambda k: pa.array(np.concatenate([f[k] for f in found] or [np.zeros(0)]).astype(np.int32))
            key = np.concatenate([f[0].astype(np.uint64) for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.repeat(batch.column("row").to_numpy(), size)), "key": pa.array(key), "whole": pa.array(whole, pa.binary()), "low": col(1), "place": col(2), "high": col(3), "end": col(4)})

    return rows.select("row", "raw").mapInArrow(run, "row long, key long, whole binary, low int, place int, high int, end int")


def with_bytes(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """The needed contexts with their bytes. needed: a list of contexts per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, raw, wanted in zip(*(batch.column(c) for c in ("row", "raw", "wanted")), strict=True):
                raw = raw.as_buffer().to_pybytes()
                out += [(x["key"], x["kinds"], row.as_py(), x["across"], x["low"], x["place"] - x["low"], x["high"] - x["low"], raw[x["low"] : x["end"]]) for x in wanted.as_py()]
                if len(out) > 20_000:
                    yield table(out)
                    out = []
            yield table(out)

    def table(out: list) -> pa.RecordBatch:
        kinds = {"key": pa.int64(), "kinds": pa.int64(), "row": pa.int64(), "across": pa.bool_(), "low": pa.int32(), "anchor": pa.int32(), "windows": pa.int32(), "bytes": pa.binary()}
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_pydict({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), cols, strict=True)})

    joined = rows.join(needed, "row").select("row", "raw", "wanted")
    return joined.mapInArrow(run, "key long, kinds long, row long, across boolean, low int, anchor int, windows int, bytes binary")


def common(a: bytes, b: bytes) -> int:
    """How many first bytes are the same."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common length, first, end) of the nodes of the tree, from the common prefixes of neighbours: a stack scan."""
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*prefixes, 0]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            yield length, first, i + 1
        if x and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, contexts) of repeats around an anchor. lefts: what stands before it, reversed.

    In each interval the contexts share `right` bytes; sorted by their left sides, a run in which neighbours share at
    least what is missing to `length` is a repeat with all its occurrences. A run whose members all have one and the
    same longer left extension would be reported as that; its length is the least that neighbours share, so what
    stands before it differs or ends (it is left-diverse), and longer repeats within it come from its own tree.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    prefixes = [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    for right, first, end in intervals(prefixes):
        members = sorted(order[first:end], key=lefts.__getitem__)
        shared = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        for left, a, b in intervals(shared):
            if left + right >= length:
                yield left, right, members[a:b]
        if right >= length and min(shared) == 0:
            yield 0, right, members


SPANS = "row long, start int, end int, across boolean"


def covers(contexts: DataFrame, short: int) -> DataFrame:
    """SPANS of the maximal repeats of each anchor's group, for each context that has any; across: they stand in another row as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            keys = rows["key"].to_numpy()
            row, low, anchor = (rows[c].to_numpy() for c in ("row", "low", "anchor"))
            across, raw = rows["across"].to_pylist(), rows["bytes"].to_pylist()
            ends = np.flatnonzero(np.concatenate((np.diff(keys) != 0, [True]))) + 1
            out, begin = [], 0
            for end in ends.tolist():
                lefts = [raw[i][: anchor[i]][::-1] for i in range(begin, end)]
                rights = [raw[i][anchor[i] :] for i in range(begin, end)]
                own = row[begin:end].tolist()
                spans: list[dict[tuple[int, int], bool]] = [{} for _ in own]
                for left, right, members in maximal_repeats(lefts, rights, short):
                    first = own[members[0]]
                    far = any(own[m] != first or across[begin + m] for m in members)
                    for m in members:
                        spans[m][left, right] = spans[m].get((left, right), False) or far
                for i, found in enumerate(spans):
                    base = int(low[begin + i] + anchor[begin + i])
                    out += [(own[i], base - left, base + right, far) for (left, right), far in widest(found)]
                begin = end
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for (n, k), c in zip({"row": pa.int64(), "start": pa.int32(), "end": pa.int32(), "across": pa.bool_()}.items(), list(zip(*out, strict=True)) or [()] * 4, strict=True)})

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def widest(spans: dict[tuple[int, int], bool]) -> list[tuple[tuple[int, int], bool]]:
    """The spans (left, right of an anchor; across) that lie in no other one that tells as much."""
    out: list[tuple[tuple[int, int], bool]] = []
    for (left, right), far in sorted(spans.items(), key=lambda x: (-x[0][0], -x[0][1], not x[1])):
        if not any(right <= r and f >= far for (_, r), f in out):
            out.append(((left, right), far))
    return out


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covers_by_windows(contexts: DataFrame, length: int) -> DataFrame:
    """SPANS of repeated windows of `length` bytes, for groups of very many contexts: every window's digest is counted over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.select(["row", "low", "windows", "bytes"]).to_pylist():
                raw = x["bytes"]
                n = min(x["windows"] + 1, len(raw) - length + 1)
                digest = [hashlib.blake2b(raw[s : s + length], digest_size=16).digest() for s in range(n)]
                yield pa.RecordBatch.from_pydict({"window": pa.array(digest, pa.binary()), "row": pa.array([x["row"]] * len(digest), pa.int64()), "start": pa.array(range(x["low"], x["low"] + len(digest)), pa.int32())})

    each = contexts.mapInArrow(run, "window binary, row long, start int")
    shared = each.groupBy("window").agg(F.count("*").alias("n"), (F.min("row") != F.max("row")).alias("across")).where("n > 1")
    return each.join(shared, "window").select("row", "start", (F.col("start") + length).cast("int").alias("end"), "across")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shared: int = SHARED, short: int = SHORT) -> DataFrame:
    """row, spans: start, end, across of the repeats of `short` bytes or more in each row that has any; they may overlap."""
    short = min(short, length)
    rows = keyed(docs)
    found = written(segments(rows, length, gram, short), "segments")
    kinds = found.groupBy("key", "whole").agg(F.count("*").alias("n"), (F.min("row") != F.max("row")).alias("across"), F.min(F.struct("row", "low")).alias("one"))
    per_key = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    told = written(found.join(kinds.join(per_key, "key"), ["key", "whole"]).where("kinds > 1 OR n > 1").drop("whole"), "told")
    whole = told.where("n > 1").select("row", F.col("low").alias("start"), "end", "across")
    one = (F.col("one.row") == F.col("row")) & (F.col("one.low") == F.col("low"))
    needed = told.where("kinds > 1").where(one).groupBy("row").agg(F.collect_list(F.struct("key", "kinds", "across", "low", "place", "high", "end")).alias("wanted"))
    drop_path(docs.sparkSession, found)
    contexts = with_bytes(rows, needed)
    spans = whole.unionByName(covers(contexts.where(F.col("kinds") <= shared), short))
    if told.where(F.col("kinds") > shared).limit(1).count():
        many = written(contexts.where(F.col("kinds") > shared), "many")
        for n in sorted({short, length}):
            spans = spans.unionByName(covers_by_windows(many, n))
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "end", "across")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shared: int = SHARED, short: int = SHORT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, kept (the bytes that are left) of each row of docs.

    n_passages: how many runs of the text hold a repeat of over WORDS words that stands in another row too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, spans in zip(batch.column("raw"), batch.column("spans"), strict=True):
                raw, at, kept = raw.as_buffer().to_pybytes(), 0, []
                found = [(x["start"], x["end"], x["across"]) for x in spans.as_py() or ()]
                gone = joined_spans(sorted((a, b) for a, b, _ in found if b - a >= length))
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                passages = [(a, b) for a, b in joined_spans(sorted((a, b) for a, b, far in found if far)) if len(raw[a:b].split()) > WORDS]
                rows.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), len(passages), left))
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passages": pa.int64(), "kept": pa.binary()}
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {n: pa.array(c, k) for (n, k), c in zip(kinds.items(), cols, strict=True)})

    docs = steady(docs)
    joined = keyed(docs).join(repeated_spans(docs, length, gram, shared, short), "row", "left").select("doc_id", "raw", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, kept binary")
