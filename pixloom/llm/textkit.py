"""Words and word shingles of Arrow text columns as numpy hashes, a bounded slice of text at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_M1, _M2, _BASE = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), 0x9E3779B97F4A7C15
#: Multipliers of the places in a shingle.
_PLACE = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], U)
#: The separators of the contracts: space and \\t to \\r.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: well-spread bits from nearby values."""
    with np.errstate(over="ignore"):
        x = x + U((_BASE * (salt + 1)) % (1 << 64))
        x = (x ^ (x >> U(30))) * _M1
        x = (x ^ (x >> U(27))) * _M2
        return x ^ (x >> U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first bytes, by their number, of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
#: ASCII signs count as separators too where a text is compared loosely.
_IS_SIGN = _IS_SEP.copy()
_IS_SIGN[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def slices(text: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text has a range of its own."""
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A large_string array without nulls; null reads as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string()).fill_null("")


class Words:
    """The words of the rows ``lo`` to ``hi`` of a text column.

    hash: a 64-bit hash of each lower-cased (A-Z) word's bytes; first: where each row's words begin in it, one more than rows.
    start, end: byte positions in the slice.
    loose: signs of ASCII separate words too, and Latin capitals fold.
    """

    def __init__(self, text: pa.Array, lo: int, hi: int, loose: bool = False):
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset + lo : text.offset + hi + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        if loose and len(data):
            capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
            data = data.copy()
            data[1:][capital] += 0x20
        inside = ~(_IS_SIGN if loose else _IS_SEP)[data]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < len(data)]] = False
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[off[1:][off[1:] > 0] - 1] = False
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.offsets = off
        if not len(self.start):
            self._data, self.hash = np.zeros(16, np.uint8), np.zeros(0, U)
            return
        self._data = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
        # Up to 16 bytes are the words of 8 bytes at both ends, and their number.
        eight = np.ndarray(len(data) + 8, "<u8", self._data, strides=(1,))
        length = self.end - self.start
        with np.errstate(over="ignore"):
            self.hash = mix(mix(eight[self.start] & _FIRST[np.minimum(length, 8)], 20) + length.astype(U) * U(_BASE), 21)
            two = np.flatnonzero(length > 8)
            self.hash[two] = mix(self.hash[two] + mix(eight[self.end[two] - 8], 22), 23)
        far = np.flatnonzero(length > 16)
        if len(far):
            words = self._bytes(far).dictionary_encode()
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), U, len(words.dictionary))
            self.hash[far] = hashes[words.indices.to_numpy()]

    def _bytes(self, which: np.ndarray) -> pa.Array:
        """The bytes of some words, lower-cased."""
        length = self.end[which] - self.start[which]
        ends = np.concatenate([[0], np.cumsum(length)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.start[which], length)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(self._data[place])])

    @cached_property
    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word's hash within the slice, the hash of each number)."""
        encoded = pa.array(self.hash.view(np.int64)).dictionary_encode()
        return encoded.indices.to_numpy(), encoded.dictionary.to_numpy().view(U)

    def exact(self) -> np.ndarray:
        """The same number for the same lower-cased word within the slice, and for no other: by its bytes."""
        return self._bytes(np.arange(len(self.start))).dictionary_encode().indices.to_numpy()

    def row(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]

    def runs(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; those that reach into another row mean nothing."""
        return runs(self.hash, k)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) < k:
        return np.zeros(0, U)
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for j in range(k):
            out += words[j : j + n] * _PLACE[j]
    return mix(out, k)


def exact_runs(codes: np.ndarray, k: int) -> np.ndarray:
    """The same number for the same k codes from each place on, and for no others."""
    out = codes.astype(np.int64)
    for j in range(1, k):
        out = out[: len(codes) - j] * (int(codes.max()) + 1) + codes[j:] if len(codes) > j else np.zeros(0, np.int64)
        out = pa.array(out).dictionary_encode().indices.to_numpy().astype(np.int64)
    return out


def shingle_sets(words: Words, k: int = 5) -> Iterator[np.ndarray]:
    """Of each row the sorted distinct hashes of its k-word shingles; with fewer words the whole sequence as one."""
    every = words.runs(k)
    for i in range(len(words.first) - 1):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield runs(words.hash[a:b], int(b - a))
        else:
            yield every[:0]


def placed_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the values from each ``start`` to before ``end``, in their order: each is mixed with its place before they are
    added, so that no exchange of equal parts cancels out."""
    length = end - start
    if not len(length):
        return np.zeros(0, U)
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    with np.errstate(over="ignore"):
        mixed = mix(mix(values[np.repeat(start, length) + place], salt) + place.astype(U) * U(_BASE), salt)
        total = np.concatenate([np.zeros(1, U), np.cumsum(mixed)])
        last = np.cumsum(length)
        return mix(total[last] - total[last - length] + length.astype(U), salt)
