"""Vocabulary files of byte-pair tokenizers: symbols, merges as a numpy hash table, and cutting texts into pieces.

A text is cut at white space first, since no piece runs over such a cut; what the pieces of a chunk give is kept in
dictionaries of the Python worker, bounded by bytes, because most chunks of a corpus repeat. Patterns, special strings
and the decoder are those that the file names; a file with parts that are not known here is refused.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the split pattern of byte-level files that say "use_regex" without naming one.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << np.int64(40)
#: Bytes that a dictionary of a worker may hold, about; keys of more characters are held for one batch alone.
HELD, LONG_KEY = 64_000_000, 1000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """(left id, right id) -> (rank, merged id), looked up for whole arrays by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, new: np.ndarray):
        self.new = new.astype(np.int64)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = int(np.ceil(np.log2(max(2, len(keys))))) + 2
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << self.bits, NONE)
        at, todo = self.slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            free = todo[self.rank[at[todo]] == NONE]
            self.rank[at[free][::-1]] = free[::-1]  # the first of several stays
            self.keys[at[free][::-1]] = keys[free][::-1]
            todo = todo[self.rank[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.table = dict(zip(zip(left.tolist(), right.tolist(), strict=True), range(len(left)), strict=True))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE if it doesn't merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self.slot(keys)
        found = np.where(self.keys[at] == keys, self.rank[at], NONE)
        todo = np.flatnonzero((found == NONE) & (self.rank[at] != NONE))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[todo]] == keys[todo]
            found[todo[hit]] = self.rank[at[todo[hit]]]
            todo = todo[~hit & (self.rank[at[todo]] != NONE)]
        return found


def is_latin(chunk: str) -> bool:
    """Only characters up to U+00FF: they are composed already, and lower() does for them what the normalizer does."""
    try:
        chunk.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def split_pattern(spec: dict) -> str:
    """The pattern of the file's pre-tokenizer, whose matches are the pieces."""
    parts = spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]
    first, rest = parts[0], parts[1:]
    if first["type"] == "Split" and first["invert"] and first["behavior"] == "Removed" and [(x["type"], x["use_regex"], x["add_prefix_space"]) for x in rest] == [("ByteLevel", False, False)]:
        return first["pattern"]["Regex"]
    if first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not rest:
        return BYTE_PATTERN
    raise ValueError(f"pre-tokenizer of another kind: {spec['pre_tokenizer']}")


def lower_cases(normalizer: dict | None) -> bool:
    """Whether the file's normalizer composes characters, makes white space single spaces and lower-cases; else it must have none."""
    if normalizer is None:
        return False
    parts = normalizer.get("normalizers") or [normalizer]
    if [x["type"] for x in parts] == ["NFC", "Replace", "Lowercase"] and (parts[1]["pattern"], parts[1]["content"]) == ({"Regex": "\\s+"}, " "):
        return True
    raise ValueError(f"normalizer of another kind: {normalizer}")


class Vocabulary:
    """A tokenizer file of the byte-pair kind, with or without word ends and lower-casing."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] or re.search(r"\s", x["content"]) for x in spec["added_tokens"]):
            raise ValueError("special strings of another kind")
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.end = model.get("end_of_word_suffix") or ""
        self.lowers = lower_cases(spec["normalizer"])
        self.pattern = regex.compile(split_pattern(spec))
        self.decoder = (spec["decoder"] or {}).get("type")
        self.normalizer = None
        if self.lowers:
            from tokenizers import Tokenizer

            self.normalizer = Tokenizer.from_file(path).normalizer
        chars = byte_symbols()
        self.symbol = np.array([self.ids[c] for c in chars], np.int64)
        self.last = np.array([self.ids[c + self.end] for c in chars], np.int64)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        ids = self.ids
        self.merges = Merges(*(np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True)))
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.specials.items()}

    def start(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces before any merge, one after the other, and how many each has."""
        raw = [p.encode("utf-8") for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        values = np.frombuffer(b"".join(raw), np.uint8)
        out = self.symbol[values]
        if self.end:
            ends = np.cumsum(lengths) - 1
            out[ends] = self.last[values[ends]]
        return out, lengths

    def pieces(self, chunk: str) -> list[str | int]:
        """The pieces of a part of a text; the id of each special string that stands in it."""
        if not self.special or not self.special.search(chunk):
            return self.plain(chunk)
        out, at = [], 0
        for m in self.special.finditer(chunk):
            out += [*self.plain(chunk[at : m.start()]), self.specials[m[0]]]
            at = m.end()
        return out + self.plain(chunk[at:])

    def plain(self, chunk: str) -> list[str]:
        """The pieces of a chunk without special strings. Most are one word, with or without a comma or full stop."""
        if self.lowers:
            chunk = chunk.lower() if chunk.isascii() or is_latin(chunk) else self.normalizer.normalize_str(chunk)
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)


class Kept(dict):
    """What each key gives, filled for many keys at a time and bounded by bytes.

    When half the bound is full, what is held becomes the older part; of that only what is used again stays.
    """

    def __init__(self, fill: Callable[[list[str]], Iterable], size: int = HELD, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.make, self.size, self.fixed = fill, size, fixed or {}
        self.older, self.long, self.held = {}, [], 0

    def cover(self, keys: Iterable[str]) -> None:
        """Afterwards every one of these different keys is in it."""
        for k in self.long:
            self.pop(k, None)
        self.long = []
        if 2 * self.held > self.size:
            self.older = dict(self)
            self.clear()
            self.update(self.fixed)
            self.held = 0
        missing = [k for k in keys if k not in self]
        if self.older:
            again = [k for k in missing if k in self.older]
            self.add(again, map(self.older.__getitem__, again))
            missing = [k for k in missing if k not in self]
        for i in range(0, len(missing), 50_000):
            part = missing[i : i + 50_000]
            self.add(part, self.make(part))

    def add(self, keys: list[str], values: Iterable) -> None:
        values = list(values)
        self.update(zip(keys, values, strict=True))
        self.long += [k for k in keys if len(k) > LONG_KEY]
        self.held += 160 * len(keys) + sum(map(len, keys)) + (sum(map(len, values)) if values and isinstance(values[0], bytes) else 0)


class Pieces(Kept):
    """What each piece gives. special: what a special id gives."""

    def __init__(self, vocabulary: Vocabulary, make: Callable[[list[str]], Iterable], special: Callable, size: int = HELD):
        super().__init__(make, size, {i: special(i) for i in vocabulary.specials.values()})
        self.vocabulary = vocabulary

    def cut(self, chunks: list[str], before: str = "") -> list[list[str | int]]:
        """The pieces of each chunk, all of which are in it afterwards."""
        cut = [self.vocabulary.pieces(before + c) for c in chunks]
        self.cover({p for pieces in cut for p in pieces})
        return cut


def as_bytes(i: int) -> bytes:
    """An id as four bytes."""
    return i.to_bytes(4, "little")


class Ids:
    """Ids of columns of texts by a vocabulary file that drops white space. encode: the ids of many pieces, as bytes."""

    def __init__(self, own: Vocabulary, encode: Callable[[list[str]], Iterable[bytes]]):
        find = own.pattern.findall
        if find(" ") or any(find(f"{a}{b} c") != [*find(a), b, "c"] for a in ("ab", "don't", "x-y") for b in ",."):
            raise ValueError("pieces of this vocabulary run over white space, or from letters to a comma or full stop")
        self.own, self.encode = own, encode
        self.pieces = Pieces(own, encode, as_bytes, HELD // 2)
        self.clear()

    def clear(self) -> None:
        """Forgets all chunks. Known are: the chunks, their ids one after the other, where each one's begin, how many, and whether it was met lately."""
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.begin, self.size, self.met = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)

    def trim(self) -> None:
        """Keeps what was met since the last time, or nothing if that is too much as well. Memory stays bounded by bytes."""
        if self.known.nbytes + self.flat.nbytes + 9 * len(self.met) <= 2 * HELD:
            return
        stay = np.flatnonzero(self.met)
        size = self.size[stay]
        begin = np.cumsum(size, dtype=np.int32) - size
        self.flat = self.flat[np.repeat(self.begin[stay] - begin, size) + np.arange(int(size.sum()), dtype=np.int32)]
        self.known, self.begin, self.size, self.met = self.known.take(pa.array(stay)), begin, size, np.zeros(len(stay), bool)
        if self.known.nbytes + self.flat.nbytes > HELD:
            self.clear()

    def learn(self, words: pa.Array) -> None:
        """Puts new chunks behind the known ones."""
        found = self.join(words.to_pylist())
        size = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        begin = np.cumsum(size, dtype=np.int32) - size + np.int32(len(self.flat))
        self.known, self.flat = pa.concat_arrays([self.known, words]), np.concatenate((self.flat, np.frombuffer(b"".join(found), "<u4")))
        self.begin, self.size, self.met = np.concatenate((self.begin, begin)), np.concatenate((self.size, size)), np.concatenate((self.met, np.zeros(len(size), bool)))

    def join(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. Most are one piece as they stand."""
        alone = [c.isalpha() and (c.isascii() or is_latin(c)) and (c.islower() or not self.own.lowers) for c in chunks]
        single = iter(self.encode([c for c, one in zip(chunks, alone, strict=True) if one]))
        of, cut = self.pieces.__getitem__, iter(self.pieces.cut([c for c, one in zip(chunks, alone, strict=True) if not one]))
        return [next(single) if one else b"".join(map(of, next(cut))) for one in alone]

    def words(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of the texts, and the edges of each text among them. A comma or full stop after a letter a-z at the
        end of a chunk becomes one of its own. A-Z are lower-cased where that can't make a special string."""
        if self.own.lowers:
            low = pc.ascii_lower(column)
            if not any(pc.any(pc.match_substring(low, x)).as_py() for x in self.own.specials):
                column = low
        cut = pc.ascii_split_whitespace(column)
        words, edges = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        if not len(words):
            return words, edges
        _, where, data = words.buffers()
        ends = np.frombuffer(where, np.int32, len(words) + 1, 4 * words.offset)
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        long = np.flatnonzero(np.diff(ends) > 1)
        end = ends[long + 1]
        letter = raw[end - 2] | np.uint8(32)
        split = long[((raw[end - 1] == 44) | (raw[end - 1] == 46)) & (letter >= 97) & (letter <= 122)]
        places = np.insert(ends, split + 1, ends[split + 1] - 1)
        return pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), data), edges + np.searchsorted(split, edges)

    def of(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has; `end` is put after each text."""
        self.trim()
        chunks, edges = self.words(column)
        at = pc.index_in(chunks, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            coded = chunks.take(pa.array(new)).dictionary_encode()
            at[new] = len(self.known) + coded.indices.to_numpy()
            self.learn(coded.dictionary)
        self.met[at] = True
        flat, begin, size = self.flat, self.begin, self.size
        if end is not None:
            at = np.insert(at, edges[1:], len(size))
            edges = edges + np.arange(len(edges))
            begin, size, flat = np.append(begin, np.int32(len(flat))), np.append(size, np.int32(1)), np.append(flat, np.uint32(end))
        n = size[at]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)))
        where = np.int32 if ends[-1] < 2**31 else np.int64
        return flat[np.repeat(begin[at] - ends[:-1].astype(where), n) + np.arange(ends[-1], dtype=where)], np.diff(ends[edges])


_loaded: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, read once in each process."""
    key = (path, os.path.getmtime(path))
    if key not in _loaded:
        _loaded[key] = Vocabulary(path)
    return _loaded[key]


_double = re.compile(r"\s\s|^\s|\s\Z")


def spaced_chunks(text: str) -> tuple[str, list[str]]:
    """The part before the first cut, and the parts after each; a cut is one space between two other characters."""
    if _double.search(text):
        first, *rest = re.split(r"(?<=\S) (?=\S)", text)
    else:
        first, *rest = text.split(" ")
    return first, rest


def grouped_texts(texts: list[str], size: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in order, in groups of about `size` characters, so that what is held stays bounded."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def slices(column: pa.Array, size: int = 16_000_000) -> Iterator[pa.Array]:
    """The column in parts of about `size` bytes of text."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield column.slice(at, to - at)
        at = to
