"""Texts cut into space-led units, and units into pre-tokens, for a whole Arrow batch at once.

A space that follows something other than white space always starts a new token of the
tokenizers used here, so a text is the sequence of its units and each distinct unit of a
batch needs the tokenizer once. A text with white space before a space is one unit.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from struct import pack
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SLICE_BYTES = 32_000_000
IRREGULAR = r"[\pZ\x00-\x20\x{85}] "
#: Units of these characters mean the same to Python's patterns and the libraries'.
PLAIN = regex.compile(r"[ \n!-~¡-ÿ]*")
#: Pre-tokens a worker remembers between batches.
REMEMBERED = 600_000


class Units(NamedTuple):
    """``codes[bounds[i]:bounds[i + 1]]`` are the units of text i, as places in ``words``."""

    codes: np.ndarray
    bounds: np.ndarray
    words: list[str]


def parts(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``most`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The ``parts`` of all batches of a task; then Arrow's free memory goes back to the system, as the worker lives on beside its executor."""
    for batch in batches:
        yield from parts(batch, column, most)
    pa.default_memory_pool().release_unused()


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as 64-bit strings, null as the empty text."""
    return pc.fill_null(batch[column].cast(pa.large_string()), "")


def units(texts: pa.Array, named: bool = True) -> Units:
    """The units of each text; without ``named`` only their codes, which are the same for the same texts."""
    odd = pc.match_substring_regex(texts, IRREGULAR)
    cut = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), texts), " ")
    bounds = cut.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = cut.flatten().dictionary_encode()
    keys = coded.indices.to_numpy().astype(np.int64) * 2 + 1
    keys[bounds[:-1]] -= 1
    used = np.zeros(2 * len(coded.dictionary), bool)
    used[keys] = True
    kept = np.flatnonzero(used)
    places = np.cumsum(used) - 1
    codes = places[keys]
    whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    codes[bounds[whole]] = len(kept) + np.arange(len(whole))
    if not named:
        return Units(codes, bounds, [])
    spaces = pa.array(["", " "], pa.large_string()).take(pa.array(kept & 1))
    words = pc.binary_join_element_wise(spaces, coded.dictionary.take(pa.array(kept >> 1)), pa.scalar("", pa.large_string())).to_pylist()
    words += texts.take(pa.array(whole)).to_pylist()
    return Units(codes, bounds, words)


class Pieces(NamedTuple):
    """``codes[bounds[i]:bounds[i + 1]]`` are the pre-tokens of unit i, as places in ``words``."""

    codes: np.ndarray
    bounds: np.ndarray
    words: list


def pre_tokens(words: list[str], split: Callable[[str], list], whole: Callable[[str], str] | None = None) -> Pieces:
    """``split`` gives the pre-tokens of one unit, ``whole`` that of a unit of ASCII letters; every distinct one is kept once."""
    place: dict = {}
    codes, sizes = [], []
    for word in words:
        if whole is not None and word.isascii() and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            sizes.append(1)
            codes.append(place.setdefault(whole(word), len(place)))
            continue
        parts = split(word)
        sizes.append(len(parts))
        codes += [place.setdefault(p, len(place)) for p in parts]
    return Pieces(np.array(codes, np.int64), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64), list(place))


def spread(bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of the chosen groups one after the other: (place in ``chosen``, member)."""
    sizes = (bounds[1:] - bounds[:-1])[chosen]
    owner = np.repeat(np.arange(len(chosen)), sizes)
    first = np.cumsum(sizes) - sizes
    return owner, np.arange(len(owner)) - np.repeat(first - bounds[:-1][chosen], sizes)


def joined(values: list[bytes], codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values of the codes one after the other, and where each starts and the last ends."""
    return taken_bytes(pa.array(values, pa.large_binary()), codes)


def taken_bytes(values: pa.Array, codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    taken = values.take(pa.array(codes))
    if not len(taken):
        return memoryview(b""), np.zeros(1, np.int64)
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(taken) + 1]
    return memoryview(taken.buffers()[2] or b""), offsets


BYTE_CHARS = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None for b in range(256)]
for _n, _b in enumerate(b for b, c in enumerate(BYTE_CHARS) if c is None):
    BYTE_CHARS[_b] = chr(256 + _n)
BYTE_TABLE = {b: ord(c) for b, c in enumerate(BYTE_CHARS)}

_loaded: dict = {}


class LibraryTokenizer:
    """A ``tokenizers`` file applied to units: the library's merges once per distinct pre-token.

    Plain units are split by ``pattern`` here and handed to the library's model; every
    other unit (other scripts, strings of special tokens) goes through the whole library.
    """

    def __init__(self, path: str, pattern: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(pattern).findall
        self.lower = lower
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict = {}

    def split(self, unit: str) -> list:
        """Pre-tokens; a unit for the whole library is one tuple."""
        if PLAIN.fullmatch(unit) is None or "<" in unit and any(s in unit.lower() for s in self.special):
            return [(unit,)]
        return self.find(unit.lower() if self.lower else unit)

    def whole(self, unit: str) -> str:
        """The one pre-token of a unit of ASCII letters; the word pattern drops the space."""
        return unit.lstrip(" ").lower() if self.lower else unit

    def ids(self, pre_token) -> list[int]:
        if isinstance(pre_token, tuple):
            return self.tokenizer.encode(pre_token[0], add_special_tokens=False).ids
        if pre_token.isascii() and pre_token[1:].isalpha():
            text = BYTE_CHARS[ord(pre_token[0])] + pre_token[1:]
        else:
            text = pre_token.encode().decode("latin-1").translate(BYTE_TABLE)
        return [t.id for t in self.model.tokenize(text)]

    def encoded(self, pre_tokens: list) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for p in pre_tokens:
            held = known.get(p)
            if held is None:
                ids = self.ids(p)
                held = pack(f"<{len(ids)}I", *ids)
                known[p] = held
            out.append(held)
        return out


def library_tokenizer(path: str, pattern: str, lower: bool) -> LibraryTokenizer:
    """Loaded once per worker; the file must be there on every worker."""
    key = (path, pattern, lower)
    if key not in _loaded:
        _loaded[key] = LibraryTokenizer(path, pattern, lower)
    return _loaded[key]


#: The splitting patterns of the two public ``tokenizers`` files (fixed values).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encoded_units(words: list[str], coder: LibraryTokenizer, kind: str = "<u4") -> pa.Array:
    """Ids of each unit as binary values of integers of ``kind``."""
    parts = pre_tokens(words, coder.split, coder.whole)
    flat, at = joined(coder.encoded(parts.words), parts.codes)
    ids = np.ascontiguousarray(np.frombuffer(flat, "<u4", at[-1] // 4).astype(kind, copy=False))
    offsets = np.ascontiguousarray(at[parts.bounds] // 4 * ids.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def encoded_texts(texts: pa.Array, coder: LibraryTokenizer) -> tuple[memoryview, np.ndarray]:
    """Ids (4 bytes each) of all texts one after the other, and the byte where each text starts."""
    cut = units(texts)
    data, starts = taken_bytes(encoded_units(cut.words, coder), cut.codes)
    return data, starts[cut.bounds]
