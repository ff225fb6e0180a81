"""Token counts by rank-synchronous array merging.

Pieces of many texts lie as one ragged numpy array. In each round every sequence merges all occurrences of its own
lowest-ranked pair at the same time (in a run of overlapping ones every second, from the left), which gives what
merging one by one does: a pair with the new symbol ranks after the merge that makes the symbol. The symbols that
survive are counted.

Defined results: null and empty texts have 0 tokens; texts of any length are counted whole; repeated rows are counted
each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import texts
from quarry.llm.vocabulary import HELD, NONE, Kept, Merges, Pieces, grouped_texts, spaced_chunks, vocabulary

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merged_lengths(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols of each sequence are left when no pair merges any more. symbols: one sequence after the other."""
    out = np.zeros(len(lengths), np.int64)
    owner = np.flatnonzero(lengths)
    lengths = lengths[owner]
    ranks = pair_ranks(symbols, lengths, merges)
    while len(owner):
        starts = np.cumsum(lengths) - lengths
        least = np.minimum.reduceat(ranks, starts)
        done = least == NONE
        if done.any():
            out[owner[done]] = lengths[done]
            stay = np.repeat(~done, lengths)
            symbols, ranks = symbols[stay], ranks[stay]
            owner, lengths, least = owner[~done], lengths[~done], least[~done]
            if not len(owner):
                break
            starts = np.cumsum(lengths) - lengths
        hit = np.flatnonzero(ranks == np.repeat(least, lengths))
        run = np.concatenate(([True], np.diff(hit) != 1))
        first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        symbols[hit] = merges.new[ranks[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        lost = np.bincount(np.searchsorted(starts, hit, "right") - 1, minlength=len(lengths))
        moved = hit - np.arange(len(hit))
        symbols, ranks = symbols[keep], ranks[keep]
        lengths = lengths - lost
        ends = np.zeros(len(symbols), bool)
        ends[np.cumsum(lengths) - 1] = True
        begins = np.cumsum(lengths) - lengths
        before = moved[~np.isin(moved, begins, assume_unique=True)] - 1 if len(moved) < 64 else moved[~at(begins, len(symbols))[moved]] - 1
        again = np.concatenate((moved, before))
        last = ends[again]
        ranks[again[last]] = NONE
        again = again[~last]
        ranks[again] = merges.ranks(symbols[again], symbols[again + 1])
    return out


def at(where: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[where] = True
    return out


def pair_ranks(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """The rank of each symbol with the next of its sequence; NONE at ends."""
    ranks = np.full(len(symbols), NONE)
    if len(symbols) > 1:
        ranks[:-1] = merges.ranks(symbols[:-1], symbols[1:])
    if len(lengths):
        ranks[np.cumsum(lengths) - 1] = NONE
    return ranks


class Counter:
    """Counts of the tokens of texts, by one vocabulary file."""

    def __init__(self, path: str):
        own = vocabulary(path)

        self.pieces = Pieces(own, lambda pieces: merged_lengths(*own.start(pieces), own.merges).tolist(), lambda _: 1)
        self.first, self.rest = Kept(lambda chunks: self.count(chunks, ""), 8_000_000), Kept(lambda chunks: self.count(chunks, " "), 2 * HELD)

    def count(self, chunks: list[str], before: str) -> Iterator[int]:
        of = self.pieces.__getitem__
        return [of(p[0]) if len(p) == 1 else sum(map(of, p)) for p in self.pieces.cut(chunks, before)]

    def counts(self, group: list[str]) -> list[int]:
        cut = [spaced_chunks(t) if t else ("", []) for t in group]
        self.first.cover({f for f, _ in cut})
        self.rest.cover(set(chain.from_iterable(rest for _, rest in cut)))
        of = self.rest.__getitem__
        return [self.first[f] + sum(map(of, rest)) for f, rest in cut]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            n = [x for group in grouped_texts(all_texts) for x in count.counts(group)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) if t.isascii() else len(t.encode()) for t in all_texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}
            )

    return texts(docs).mapInArrow(run, SCHEMA)
