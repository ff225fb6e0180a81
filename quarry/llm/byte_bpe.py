"""Byte-level BPE by a file of ranks: the tokenizers library over Arrow batches, byte-to-character offsets, exact decoding.

A rank file lists byte strings; the pair that makes each one is found by merging its bytes with the lower ranks alone,
so the file becomes a vocabulary and a list of merges of the tokenizers library, which cuts texts by the pattern and
encodes each match separately. Bytes stand for printable characters there. Texts are cut first at single spaces between
characters that aren't white space, where no match runs on, and each different chunk of a batch is encoded once; the
ids of whole texts are gathered from those. Tokens know their bytes, so places in bytes are sums, and places in
characters come from counting the bytes that begin one: a token with a part of a character has the whole character's
place. Decoding puts tokens' bytes together before any are read as characters, so split characters come out whole.

Defined results: null texts are empty and have no tokens; strings of special tokens are ordinary text; texts of any
length are encoded whole; repeated rows and rows without doc_id are encoded each on its own; an empty table gives an
empty result; only doc_id and text are read. Bytes that don't make a character (of ids that aren't a text's) decode to
U+FFFD in texts and stay as they are in bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.common import texts
from quarry.llm.vocabulary import byte_symbols, slices

#: Chunks that are given to the library at once.
AT_ONCE = 20_000
_byte = np.arange(256)
_blank = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))
#: Bytes before a cut: ASCII without white space; or any last byte of a character that begins with one of WIDE.
BEFORE, WIDE = (_byte < 128) & ~_blank, (_byte >= 0xC3) & (_byte <= 0xDF)
#: Bytes after the space: none of white space, or of characters that may be.
AFTER = ~_blank & ~np.isin(_byte, [0xC2, 0xE1, 0xE2, 0xE3])


def read_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file (base64, a space, the rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two strings that the last merge of a token joins: its bytes merged with lower ranks alone."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= ranks[token]:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) != 2:
        raise ValueError(f"no pair of lower ranks makes {token!r}")
    return parts[0], parts[1]


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        sign = byte_symbols()
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a rank file without all bytes")
        spelt = lambda raw: "".join(map(sign.__getitem__, raw))
        merges = [(spelt(a), spelt(b)) for a, b in (pair_of(t, ranks) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1)]
        self.library = Tokenizer(models.BPE({spelt(t): r for t, r in ranks.items()}, merges))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # decoding reverses the byte table: from the library's characters back to bytes
        byte_of = {c: b for b, c in enumerate(sign)}
        size = max(ranks.values()) + 1
        token = (self.library.id_to_token(i) for i in range(size))
        self.tokens = pa.array([bytes(map(byte_of.__getitem__, t or "")) for t in token], pa.binary())
        self.line = ranks[b"\n"]
        self.length = pc.binary_length(self.tokens).to_numpy()
        self.numbers = pa.array(map(str, range(size)), pa.string())

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        chunks, edges = cut(column)
        coded = chunks.dictionary_encode()
        flat, begin, sizes = self.ids_of_each(coded.dictionary)
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        return flat[np.repeat(begin[at] - ends[:-1], n) + np.arange(ends[-1])], np.diff(ends[edges])

    def ids_of_each(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different chunks by the library, where those of each begin, and how many it has.

        Chunks of one word go in one text with line feeds between, which are matches and tokens of their own there.
        """
        several = pc.match_substring_regex(chunks, r"[\pZ\pC].*[\pZ\pC]|[^ \PZ]|\pC|^.* $").to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(chunks), np.int64)
        flat = [np.zeros(0, np.int32)]
        for places, parted in ((np.flatnonzero(~several), False), (np.flatnonzero(several), True)):
            for i in range(0, len(places), AT_ONCE):
                own = places[i : i + AT_ONCE]
                given = chunks.take(pa.array(own)).to_pylist()
                found = self.library.encode_batch_fast(given if parted else ["\n".join(given)], add_special_tokens=False)
                if parted:
                    sizes[own] = [len(e.ids) for e in found]
                    flat.append(np.fromiter((x for e in found for x in e.ids), np.int32, int(sizes[own].sum())))
                else:
                    ids = np.array(found[0].ids, np.int32)
                    between = ids == self.line
                    edges = np.flatnonzero(np.concatenate(([True], between, [True])))
                    sizes[own] = np.diff(edges) - 1
                    flat.append(ids[~between])
        order = np.concatenate((np.flatnonzero(~several), np.flatnonzero(several)))
        begin = np.empty(len(chunks), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(flat), begin, sizes

    def places(self, column: pa.Array, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins and ends in its text, in characters."""
        sizes = self.length[ids].astype(np.int64)
        end = np.cumsum(sizes)  # in the bytes of all texts
        _, raw = bytes_of(column)
        seen = np.concatenate((np.zeros(1, np.int64), np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before each byte
        text_ends = np.cumsum(counts)
        before = np.concatenate((np.zeros(1, np.int64), end))[text_ends - counts] if len(counts) else np.zeros(0, np.int64)
        shift = np.repeat(seen[before], counts)
        return seen[end - sizes + 1] - 1 - shift, seen[end] - shift

    @staticmethod
    def lists(of: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        edges = pa.array(np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32))))
        return pa.ListArray.from_arrays(edges, of.take(pa.array(ids)))

    def raw(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of each list of ids."""
        return pc.binary_join(self.lists(self.tokens, ids, counts), pa.scalar(b"", pa.binary()))

    def decimal(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The ids of each list in decimal digits, with a space between."""
        return pc.binary_join(self.lists(self.numbers, ids, counts), " ")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the texts among all their bytes, from 0 on, and the bytes."""
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return ends - ends[0], raw


def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of the texts, and the edges of each text among them.

    A cut is before a space with no white space on either side. Of characters beyond ASCII, those of two bytes from
    U+00C0 on are known to be none before it, and those that don't begin with a byte of such a one after it.
    """
    ends, raw = bytes_of(column)
    at = np.flatnonzero(raw[1:-1] == 32) + 1 if len(raw) > 2 else np.zeros(0, np.int64)
    last, two, following = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[at + 1]
    good = (BEFORE[last] | (WIDE[two] & (last >= 128))) & AFTER[following]
    marked = np.zeros(len(raw) + 1, bool)
    marked[at[good]] = True
    marked[ends] = True
    starts = np.flatnonzero(marked[:-1])  # an empty text has no chunk, as the next one's begins at the same place
    places = np.append(starts, len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(raw)), np.searchsorted(starts, ends)


_made: dict[tuple[str, str, float], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """Made once in each process."""
    key = (path, pattern, os.path.getmtime(path))
    if key not in _made:
        _made[key] = ByteBpe(path, pattern)
    return _made[key]


def decode(ids: list[list[int]], path: str, pattern: str = public_tokenizers.PATTERN) -> list[bytes]:
    """The bytes of each list of ids."""
    own = byte_bpe(path, pattern)
    return own.raw(np.array([i for x in ids for i in x], np.int32), np.array([*map(len, ids)], np.int64)).to_pylist()


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids, starts, ends (places of the tokens, in characters) of each row of docs: the operator's own output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_bpe(path, pattern)
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                ids, counts = own.ids(part)
                edges = pa.array(np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32))))
                starts, ends = own.places(part, ids, counts)
                lists = {n: pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for n, x in (("ids", ids), ("starts", starts), ("ends", ends))}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(part))} | lists)
                at += len(part)

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, text of each row of doc_id, ids (array<int>; null: empty); bytes that make no character become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_bpe(path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            raw = own.raw(lists.flatten().to_numpy(), counts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoded_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with a space between), decoded_sha256 (of the decoded bytes) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_bpe(path, pattern)
        sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                ids, counts = own.ids(part)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(part)), "n_tokens": pa.array(counts), "ids_sha256": sha(own.decimal(ids, counts)), "decoded_sha256": sha(own.raw(ids, counts))})
                at += len(part)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
