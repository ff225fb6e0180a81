"""Token ids on disk, compressed by Re-Pair grammars.

Documents are encoded in doc_id order. Each shard's blocks replace frequent pairs of ids by nonterminals until no pair
can be replaced LEAST times any more (a rule takes as much room as it saves at about four); a pair never runs over the
end of a document. In a round all pairs are replaced that are more frequent than the pairs that overlap them. A block is
one row of a Parquet table: the documents' ids, counts and places in the compressed sequence, the rules, how many ids
each nonterminal expands to, and the sequence. With the expansion lengths a reader finds any token of any document
without expanding what stands before it, and blocks of other doc_ids are skipped by Parquet's statistics.

Defined results: null and empty texts have the end id alone; texts of any length are stored whole, in one block each;
repeated rows are stored each, null doc_ids first; an empty table gives an empty store; only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import texts
from quarry.llm.vocabulary import Ids, is_latin, slices, vocabulary

#: Ids in a block, about; how often a pair must be replaced.
BLOCK, LEAST = 500_000, 8
#: Bits of the hash by which pairs are counted. Pairs that share a hash are told apart before they are replaced.
HASH_BITS = 18
#: The starts of so many blocks (three numbers each) are sent to all tasks; those of more are joined by shuffling.
SENT_ROWS = 200_000
BLOCKS = "shard int, block int, first_id long, last_id long, total long, base long, doc_ids array<long>, counts array<long>, places array<long>, left binary, right binary, lengths binary, sequence binary"


class Grammar:
    """Rules of nonterminals, numbered from `base`: left and right symbol, and how many ids each expands to."""

    def __init__(self, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray):
        self.base, self.left, self.right, self.lengths = base, left, right, lengths

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        return np.where(symbols < self.base, 1, np.append(self.lengths, 1)[np.maximum(symbols.astype(np.int64) - self.base, -1)])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for."""
        while (inner := symbols >= self.base).any():
            wide = np.repeat(symbols, 1 + inner)
            at = (np.cumsum(1 + inner) - (1 + inner))[inner]
            rule = symbols[inner].astype(np.int64) - self.base
            wide[at], wide[at + 1] = self.left[rule], self.right[rule]
            symbols = wide
        return symbols

    def expand_all(self, symbols: np.ndarray) -> np.ndarray:
        """The same for long sequences: each rule is expanded once, then copied to where it stands."""
        rules = np.arange(self.base, self.base + len(self.left), dtype=np.uint32)
        flat = np.concatenate((np.arange(self.base, dtype=np.uint32), self.expand(rules)))
        start = np.concatenate((np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths)).astype(np.int64)
        size = self.sizes(symbols)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        where = np.int32 if total < 2**31 else np.int64
        return flat[np.repeat((start[symbols] - (ends - size)).astype(where), size) + np.arange(total, dtype=where)]

    def tokens(self, symbols: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of a sequence, expanding only the symbols that they are in."""
        ends = np.cumsum(self.sizes(symbols))
        a, b = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
        skip = begin - (ends[a - 1] if a else 0)
        return self.expand(symbols[a:b])[skip : skip + end - begin]


class Pairs:
    """A sequence as a linked list, with the counts of its pairs and the places of those that may be frequent."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, least: int):
        n = self.n = len(ids)
        self.least, self.none = least, 1 << HASH_BITS
        self.symbol = np.append(ids.astype(np.uint32), np.uint32(0))
        self.last = np.zeros(n + 1, bool)  # of a document, or after the end
        self.last[np.append(starts[1:], n) - 1] = True
        self.last[n] = True
        self.following, self.previous = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        self.slot = np.full(n + 1, self.none, np.int32)
        self.slot[:n] = self.hashed(self.symbol[:-1].astype(np.uint64) << np.uint64(32) | self.symbol[1:])
        self.slot[self.last] = self.none
        self.count = np.zeros(self.none + 1, np.int32)
        self.add(self.slot, 1)
        self.marks = np.zeros(n + 1, bool)
        self.places = np.flatnonzero(self.count[self.slot] >= least).astype(np.int32)

    @staticmethod
    def hashed(pair: np.ndarray) -> np.ndarray:
        return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)

    def pair(self, at: np.ndarray) -> np.ndarray:
        return self.symbol[at].astype(np.uint64) << np.uint64(32) | self.symbol[self.following[at]]

    def add(self, slots: np.ndarray, one: int) -> None:
        """Counts the slots up or down."""
        if len(slots) > self.none // 8:
            self.count += one * np.bincount(slots, minlength=self.none + 1).astype(np.int32)
        else:
            np.add.at(self.count, slots, one)
        self.count[self.none] = 0

    def union(self, *parts: np.ndarray) -> np.ndarray:
        """The different places of all parts, in order."""
        if sum(map(len, parts)) < self.n // 64:
            return np.unique(np.concatenate(parts))
        for p in parts:
            self.marks[p] = True
        out = np.flatnonzero(self.marks).astype(np.int32)
        self.marks[out] = False
        return out

    def exact(self) -> bool:
        """Leaves only places whose own pair, not just its hash, is frequent; whether that took any away."""
        kind = pd.factorize(self.pair(self.places))[0]
        often = np.bincount(kind)[kind] >= self.least if len(kind) else np.zeros(0, bool)
        self.places = self.places[often]
        return not often.all()

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places to replace that don't overlap, the number of each one's pair, and the pairs. Each has LEAST places or more."""
        slot = self.slot[self.places]
        order = self.count[slot].astype(np.int64) << HASH_BITS | slot
        apart = self.following[self.places[:-1]] != self.places[1:]
        best = np.ones(len(self.places), bool)
        best[1:] &= apart | (order[1:] >= order[:-1])
        best[:-1] &= apart | (order[:-1] >= order[1:])
        if (alike := ~apart & (order[1:] == order[:-1])).any():  # in a run of one symbol every second pair
            place = np.arange(len(order))
            best &= (place - np.maximum.accumulate(np.where(np.append(False, alike), 0, place))) % 2 == 0
        at = self.places[best]
        kind, pairs = pd.factorize(self.pair(at))
        good = np.bincount(kind, minlength=len(pairs)) >= self.least
        ok = good[kind]
        return at[ok], (np.cumsum(good) - 1)[kind[ok]], pairs[good]

    def replace(self, at: np.ndarray, new: np.ndarray) -> None:
        """Puts the new symbols for the pairs at these places and counts the pairs around them anew."""
        gone, before = self.following[at], self.previous[at]
        self.add(self.slot[self.union(before[before >= 0], at, gone)], -1)
        self.symbol[at], self.last[at], self.following[at] = new, self.last[gone], self.following[gone]
        self.previous[self.following[at]] = at
        self.slot[gone] = self.none
        before = self.previous[at]
        changed = self.union(before[before >= 0], at)
        self.slot[changed] = np.where(self.last[changed], self.none, self.hashed(self.pair(changed)))
        self.add(self.slot[changed], 1)
        near = self.union(self.places, changed)
        self.places = near[self.count[self.slot[near]] >= self.least]

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left, and where documents start among them."""
        there = self.previous[self.following[: self.n]] == np.arange(self.n)
        ends = np.flatnonzero(self.last[: self.n][there])
        return self.symbol[: self.n][there], np.append(0, ends[:-1] + 1)


def compress(ids: np.ndarray, starts: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """The compressed sequence, where each document starts in it, and the grammar. starts: of the documents in ids, none of which is empty."""
    state, left, right, lengths, rounds = Pairs(ids, starts, least), [], [], [], 0
    grammar = Grammar(base, np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    while len(state.places):
        at, kind, pairs = state.chosen()
        if not len(at):
            if state.exact():
                continue
            break
        pair_left, pair_right = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
        lengths.append(grammar.sizes(pair_left) + grammar.sizes(pair_right))
        left.append(pair_left)
        right.append(pair_right)
        state.replace(at, (kind + base + len(grammar.left)).astype(np.uint32))
        grammar = Grammar(base, np.concatenate(left), np.concatenate(right), np.concatenate(lengths))
        rounds += 1
        if rounds % 4 == 0:
            state.exact()
    return *state.rest(), grammar


class Library(Ids):
    """Ids by the tokenizers library. Each new piece of a text goes to it once, many in one text with spaces between:
    no merge runs over white space, and a piece's last token is the one with the word-end mark."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.base = t.get_vocab_size()
        own = vocabulary(path)
        self.ends = np.array([(t.id_to_token(i) or "").endswith(own.end) for i in range(self.base)])
        self.again = own.normalizer.normalize_str
        super().__init__(own, self.by_library)

    def by_library(self, pieces: list[str]) -> list[bytes]:
        """The ids of each new piece, as bytes."""
        if not pieces:
            return []
        lines = [" ".join(pieces[i : i + 500]) for i in range(0, len(pieces), 500)]
        ids = np.array([x for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], "<u4")
        raw, at = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def join(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. Chunks that normalising twice would change go to the library as they are."""
        odd = {c for c in chunks if not c.isascii() and not is_latin(c) and self.again(s := self.again(c)) != s}
        found = iter(super().join([c for c in chunks if c not in odd] if odd else chunks))
        return [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() if c in odd else next(found) for c in chunks] if odd else list(found)


_libraries: dict[str, Library] = {}


def library(path: str) -> Library:
    if path not in _libraries:
        _libraries[path] = Library(path)
    return _libraries[path]


def block_row(shard: int, block: int, base: int, ids: list[np.ndarray], doc_ids: list[int | None], counts: np.ndarray, least: int = LEAST) -> pa.RecordBatch:
    """A block of the store."""
    sequence, places, g = compress(np.concatenate(ids), np.cumsum(counts) - counts, base, least)
    known = [d for d in doc_ids if d is not None]
    row = {"shard": shard, "block": block, "first_id": min(known, default=None), "last_id": max(known, default=None), "total": int(counts.sum()), "base": base, "doc_ids": doc_ids, "counts": counts.tolist(), "places": places.tolist()}
    row |= {"left": g.left.astype("<u4").tobytes(), "right": g.right.astype("<u4").tobytes(), "lengths": g.lengths.astype("<u4").tobytes(), "sequence": sequence.astype("<u4").tobytes()}
    kinds = {"shard": pa.int32(), "block": pa.int32(), "doc_ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "places": pa.list_(pa.int64()), **dict.fromkeys(("left", "right", "lengths", "sequence"), pa.binary())}
    return pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()})


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, size: int = BLOCK) -> None:
    """Encodes the rows of docs in doc_id order, `end_id` after each, and writes the blocks to a new folder.

    The range of a shard is one of (doc_id, number of the row), so that rows of one doc_id, or without any, are dealt
    out as well. A block ends after the part of a batch (16 MB of text, or one longer text) that fills it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, own = TaskContext.get().partitionId(), 0, library(tokenizer)
        ids, doc_ids, counts = [], [], []
        held = 0
        for batch in batches:
            names, at = batch.column("doc_id").to_pylist(), 0
            for part in slices(batch.column("text")):
                flat, n = own.of(part, end_id)
                ends, begin, done = np.cumsum(n), 0, 0
                while begin < len(n):
                    # rows up to the one that fills the block
                    to = min(len(n), int(np.searchsorted(ends, done + size - held)) + 1)
                    ids.append(flat[done : ends[to - 1]])
                    counts.append(n[begin:to])
                    doc_ids += names[at + begin : at + to]
                    held += int(ends[to - 1]) - done
                    begin, done = to, int(ends[to - 1])
                    if held >= size:
                        yield block_row(shard, block, own.base, ids, doc_ids, np.concatenate(counts))
                        ids, doc_ids, counts, held, block = [], [], [], 0, block + 1
                at += len(part)
        if counts:
            yield block_row(shard, block, own.base, ids, doc_ids, np.concatenate(counts))

    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text").mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def grammar_of(row: dict) -> tuple[np.ndarray, Grammar]:
    """The sequence and grammar of a block."""
    return np.frombuffer(row["sequence"], "<u4"), Grammar(row["base"], np.frombuffer(row["left"], "<u4"), np.frombuffer(row["right"], "<u4"), np.frombuffer(row["lengths"], "<u4").astype(np.int64))


def block_starts(stored: DataFrame) -> DataFrame:
    """shard, block, start (ids in all blocks before). One sum per shard is put in order; blocks are within their shard."""
    shards = stored.groupBy("shard").agg(F.sum("total").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.sum("total").over(Window.partitionBy("shard").orderBy("block")) - F.col("total")
    return stored.select("shard", "block", "total").withColumn("inside", inside).join(before, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the files."""
    stored = spark.read.schema(BLOCKS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                sequence, g = grammar_of(row)
                ids = g.expand_all(sequence).astype("<u4")
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["start"] + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})

    needed = stored.select("shard", "block", "base", "doc_ids", "counts", "left", "right", "lengths", "sequence")
    starts = block_starts(stored)
    return needed.join(F.broadcast(starts) if stored.count() <= SENT_ROWS else starts, ["shard", "block"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: So many doc_ids are looked for by ranges of their own; of more, the blocks between the least and the greatest are read.
RANGES = 200


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int], begin: int = 0, end: int | None = None) -> DataFrame:
    """doc_id, ids: tokens begin to end of the documents asked for. Only blocks whose range of doc_ids holds one are
    read (the filter reaches Parquet's statistics), and only the symbols that these tokens are in are expanded."""
    wanted = sorted(set(doc_ids))
    ranges = [(x, x) for x in wanted] if len(wanted) <= RANGES else [(wanted[0], wanted[-1])]
    near = F.lit(False)
    for a, b in ranges:
        near = near | ((F.col("first_id") <= b) & (F.col("last_id") >= a))
    stored = spark.read.schema(BLOCKS).parquet(path).where(near).select("base", "doc_ids", "counts", "places", "left", "right", "lengths", "sequence")
    own = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                sequence, g = grammar_of(row)
                places = [*row["places"], len(sequence)]
                found = [(d, g.tokens(sequence[places[k] : places[k + 1]], begin, row["counts"][k] if end is None else min(end, row["counts"][k])).tolist()) for k, d in enumerate(row["doc_ids"]) if d in own]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x[0] for x in found], pa.int64()), "ids": pa.array([x[1] for x in found], pa.list_(pa.int64()))})

    return stored.mapInArrow(run, "doc_id long, ids array<long>")
