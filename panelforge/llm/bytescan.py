"""Array code over the UTF-8 bytes of many texts at once: words, lines, hashes of words, shingles and byte windows.

Texts are read where Arrow has them, without a Python string for each. Work goes in pieces of about PIECE bytes of whole texts, so memory follows the piece, or the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_M64 = (1 << 64) - 1
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def texts(batch: pa.RecordBatch, name: str = "text", piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, offsets of the rows in them). Null counts as empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if not len(arr):
        return
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, wide)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + piece, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 .. 2**bits - 1, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p, step = np.ones(1, U64), b
        for _ in range(bits):
            p, step = np.concatenate([p, p * U64(step)]), step * step & _M64
        out.append(p)
    return out[0], out[1]


@cache
def _letters(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Rolling:
    """Polynomial hashes of all windows of an array: they choose places. Texts can be written whose windows collide, so no equality is ever taken from them."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _powers(max(10, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_letters()[data] * powers[: len(data)], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """Of the k bytes from each place."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


#: Ranges up to so many bytes are hashed side by side, eight bytes at a time; longer ones each by XXH3.
SHORT = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


class Ranges:
    """Byte ranges of an array: hashes that mix after every eight bytes, and comparison of the bytes."""

    def __init__(self, data: np.ndarray):
        self.raw = memoryview(np.ascontiguousarray(data))
        self.eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = mix(size.astype(U64) + U64(_BASE))
        live = np.flatnonzero((size > 0) & (size <= SHORT))
        at, left = starts[live], size[live]
        while len(live):
            h[live] = mix(h[live] ^ (self.eights[at] & _MASKS[np.minimum(left, 8)]))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > SHORT).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.raw[starts[i] : ends[i]])
        return h

    def equal(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` bytes from each of `one` are those from each of `two`."""
        out = np.ones(len(one), bool)
        live = np.flatnonzero((size > 0) & (size <= SHORT) & (one != two))
        a, b, left = one[live], two[live], size[live]
        while len(live):
            same = (self.eights[a] ^ self.eights[b]) & _MASKS[np.minimum(left, 8)] == 0
            out[live[~same]] = False
            more = same & (left > 8)
            live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
        for i in np.flatnonzero((size > SHORT) & (one != two)).tolist():
            out[i] = self.raw[one[i] : one[i] + size[i]] == self.raw[two[i] : two[i] + size[i]]
        return out

    def names(self, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """A number for each range, the same for equal bytes and for no others: hashes find what may be equal, the bytes decide."""
        h = self.hash(starts, ends) if h is None else h
        first, which = groups(h)
        like = first[which]
        size = ends - starts
        if not ((size == size[like]).all() and self.equal(starts, starts[like], size).all()):
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(bytes(self.raw[a:b]), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        return which


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, in the order of the keys, and the number of its key for each place."""
    o = np.argsort(keys)
    new = np.ones(len(o), bool)
    new[1:] = keys[o[1:]] != keys[o[:-1]]
    which = np.empty(len(o), np.int64)
    which[o] = np.cumsum(new) - 1
    return o[new], which


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order."""
    s = np.sort(keys)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of small numbers, the same for equal pairs and for no others."""
    wide = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * wide >= 1 << 62:
        a = groups(a)[1]
    return a * wide + b


def give_back() -> None:
    """Memory that a task no longer needs goes back to the system: the worker lives on, for tasks that have use for other things."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends where its text does."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    after = before.copy()
    before[offs] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after[:-1], after[-1] = inside, False
    after[offs] = False
    return starts, np.flatnonzero(inside & ~after[1:]) + 1


class Words:
    """Words of many texts: starts, ends, hashes; first[i] is the number of the first word of text i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray):
        self.starts, self.ends = runs(inside, offs)
        self.bytes = Ranges(data)
        self.hash = self.bytes.hash(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offs) - 1), self.counts)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word, whether they are all in one text or not."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, U64)
        h = self.hash[: n - k + 1]
        for j in range(1, k):
            h = mix(h * U64(0xD6E8FEB86659FD93) ^ self.hash[j : n - k + 1 + j])
        return h

    def shingle_sets(self, k: int) -> list[np.ndarray]:
        """Of each text the sorted distinct hashes; a text of fewer words, but not none, has one of the whole sequence."""
        h = self.shingles(k)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(distinct(h[a : b - k + 1]))
            elif b > a:
                s = mix(np.full(1, b - a, U64))
                for j in range(a, b):
                    s = mix(s * U64(0xA0761D6478BD642F) ^ self.hash[j : j + 1])
                out.append(s)
            else:
                out.append(np.zeros(0, U64))
        return out

    def repeated(self, k: int) -> np.ndarray:
        """Whether each word is in a window of k words that its text holds twice or more. Exact: words are compared, not their hashes."""
        hit = np.zeros(len(self.starts) + k, bool)
        n = len(self.starts) - k + 1
        if n > 0:
            names = self.bytes.names(self.starts, self.ends, self.hash)
            window = names[:n]
            for j in range(1, k):
                window = groups(pair(window, names[j : n + j]))[1]
            window = pair(window, self.text[:n])
            i = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
            _, which = groups(window[i])
            i = i[np.bincount(which)[which] > 1] if len(i) else i
            for j in range(k):
                hit[i + j] = True
        return hit[: len(self.starts)]


def sums_by_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
