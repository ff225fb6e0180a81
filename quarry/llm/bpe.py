"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree are (rank, position) of each adjacent pair, so the root is the leftmost of the lowest-ranked
merges. A merge changes three leaves and their ancestors, until the root says that no pair merges. Short pieces are
worked through together, one tree in each row of a numpy array; long ones have a tree of their own.

The decoded text is made from the ids that came out, by the file's vocabulary.

Defined results: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole;
repeated rows are encoded each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.common import texts
from quarry.llm.vocabulary import NONE, Ids, Merges, Vocabulary, byte_symbols, slices, vocabulary

#: Bytes of text that are encoded at once, which bounds what a task holds.
AT_ONCE = 4_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces of more symbols have a tree of their own.
LONG = 256


class Tree:
    """One piece's segment tree."""

    def __init__(self, symbols: list[int], merges: Merges):
        self.symbols, self.merges = list(symbols), merges
        n = len(symbols)
        self.leaves = 1 << max(0, (n - 2).bit_length())
        self.following, self.previous = [*range(1, n), -1], [-1, *range(n - 1)]
        none = self.none = (1 << 60, 0)
        self.nodes = [none] * (2 * self.leaves)
        for i in range(n - 1):
            self.nodes[self.leaves + i] = self.leaf(i)
        for k in range(self.leaves - 1, 0, -1):
            self.nodes[k] = min(self.nodes[2 * k], self.nodes[2 * k + 1])

    def leaf(self, i: int) -> tuple[int, int]:
        j = self.following[i]
        rank = self.merges.table.get((self.symbols[i], self.symbols[j])) if j >= 0 else None
        return self.none if rank is None else (rank, i)

    def put(self, i: int, value: tuple[int, int]) -> None:
        nodes, k = self.nodes, self.leaves + i
        nodes[k] = value
        while k > 1:
            k //= 2
            least = min(nodes[2 * k], nodes[2 * k + 1])
            if nodes[k] == least:
                break
            nodes[k] = least

    def run(self) -> list[int]:
        while len(self.symbols) > 1 and self.nodes[1] != self.none:
            rank, i = self.nodes[1]
            j = self.following[i]
            self.symbols[i] = int(self.merges.new[rank])
            after = self.following[i] = self.following[j]
            if j < len(self.symbols) - 1 or after >= 0:
                self.put(j, self.none) if j < self.leaves else None
            if after >= 0:
                self.previous[after] = i
            self.put(i, self.leaf(i))
            if (p := self.previous[i]) >= 0:
                self.put(p, self.leaf(p))
        out, i = [], 0
        while i >= 0:
            out.append(self.symbols[i])
            i = self.following[i]
        return out


def trees(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """All rows' merges by one tree a row. symbols: rows of ids, padded. Returns them with -1 where a symbol went, and the lengths left."""
    rows, width = symbols.shape
    leaves = 1 << max(0, (width - 2).bit_length())
    shift = np.int64(leaves.bit_length())
    none = NONE << shift
    place = np.arange(width)
    tree = np.full((rows, 2 * leaves), none)
    if width > 1:
        rank = merges.ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
        rank[place[1:] >= lengths[:, None]] = NONE
        tree[:, leaves : leaves + width - 1] = np.where(rank == NONE, none, (rank << shift) | place[:-1])
    for k in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    following = np.where(place + 1 < lengths[:, None], place + 1, -1)
    previous = np.broadcast_to(place - 1, symbols.shape).copy()
    left = lengths.copy()

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        k = leaves + i
        tree[r, k] = value
        while leaves > 1 and len(k) and k[0] > 1:
            k = k >> 1
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    def leaf(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = following[r, i]
        rank = np.where(j >= 0, merges.ranks(symbols[r, i], symbols[r, np.maximum(j, 0)]), NONE)
        return np.where(rank == NONE, none, (rank << shift) | i)

    r = np.flatnonzero(tree[:, 1] != none)
    while len(r):
        root = tree[r, 1]
        i = root & ((np.int64(1) << shift) - 1)
        j = following[r, i]
        symbols[r, i] = merges.new[root >> shift]
        symbols[r, j] = -1
        after = following[r, i] = following[r, j]
        left[r] -= 1
        inner = after >= 0
        previous[r[inner], after[inner]] = i[inner]
        put(r[inner], j[inner], np.full(int(inner.sum()), none))
        put(r, i, leaf(r, i))
        before = previous[r, i]
        has = before >= 0
        put(r[has], before[has], leaf(r[has], before[has]))
        r = r[tree[r, 1] != none]
    return symbols, left


def encode_pieces(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces after all merges, one piece after the other, and how many each has."""
    out, left = symbols.copy(), lengths.copy()
    starts = np.cumsum(lengths) - lengths
    low = 1
    for high in (2, 3, 5, 9, 17, 33, 65, 129, LONG + 1):
        chosen = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        for at in range(0, len(chosen), part := max(1, 2_000_000 // high)):
            some = chosen[at : at + part]
            inside = np.arange(high) < lengths[some][:, None]
            where = (starts[some][:, None] + np.arange(high))[inside]
            padded = np.zeros((len(some), high), np.int64)
            padded[inside] = symbols[where]
            done, left[some] = trees(padded, lengths[some], merges)
            out[where] = done[inside]
    for k in np.flatnonzero(lengths > LONG + 1).tolist():
        found = Tree(symbols[starts[k] : starts[k] + lengths[k]].tolist(), merges).run()
        left[k] = len(found)
        out[starts[k] : starts[k] + lengths[k]] = found + [-1] * (lengths[k] - len(found))
    return out[out >= 0], left


def encoded(pieces: list[str], own: Vocabulary) -> list[bytes]:
    """The ids of each piece, as bytes."""
    flat, left = encode_pieces(*own.start(pieces), own.merges)
    raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(left)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if pieces else []


_encoders: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    """Ids by segment trees, with dictionaries that live as long as the worker."""
    if path not in _encoders:
        own = vocabulary(path)
        _encoders[path] = Ids(own, lambda pieces: encoded(pieces, own))
    return _encoders[path]


class Decoder:
    """Texts of ids, and ids as decimal numbers, for whole columns of lists of ids."""

    def __init__(self, own: Vocabulary):
        if own.decoder not in (None, "ByteLevel"):
            raise ValueError(f"decoder of another kind: {own.decoder}")
        size = max(own.tokens) + 1
        self.bytes = {c: b for b, c in enumerate(byte_symbols())} if own.decoder else None
        self.tokens = pa.array([own.tokens.get(i, "") for i in range(size)])
        self.numbers = pa.array([str(i) for i in range(size)])

    @staticmethod
    def joined(of: pa.Array, ids: np.ndarray, counts: np.ndarray, between: str) -> pa.Array:
        edges = pa.array(np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32))))
        return pc.binary_join(pa.ListArray.from_arrays(edges, of.take(pa.array(ids))), between)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each list of ids. A file without a decoder has a space between tokens."""
        if self.bytes is None:
            return self.joined(self.tokens, ids, counts, " ")
        words = self.joined(self.tokens, ids, counts, "").to_pylist()
        return pa.array([bytes(b for c in w for b in ([self.bytes[c]] if c in self.bytes else c.encode())).decode("utf-8", "replace") for w in words], pa.string())

    def decimal(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The ids of each list in decimal digits, with a space between."""
        return self.joined(self.numbers, ids, counts, " ")


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(vocabulary(path))
    return _decoders[path]


def decode(ids: list[list[int]], path: str) -> list[str]:
    """The text of each list of ids."""
    return decoder(path).decode(np.array([i for x in ids for i in x], np.uint32), np.array([*map(len, ids)], np.int64)).to_pylist()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded of each row of docs: the operator's own output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = encoder(path), decoder(path)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text"), AT_ONCE):
                ids, counts = own.of(part)
                edges = pa.array(np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32))))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(part)), "ids": pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int32))), "decoded": back.decode(ids, counts)})
                at += len(part)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with a space between), decoded_sha256 of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = encoder(path), decoder(path)
        sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())
        for batch in batches:
            at = 0
            for part in slices(batch.column("text"), AT_ONCE):
                ids, counts = own.of(part)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(part)), "n_tokens": pa.array(counts), "ids_sha256": sha(back.decimal(ids, counts)), "decoded_sha256": sha(back.decode(ids, counts))})
                at += len(part)

    return texts(docs).mapInArrow(run, SCHEMA)
