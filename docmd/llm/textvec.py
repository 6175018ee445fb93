"""Words and hashes of whole Arrow text columns with numpy: no Python object per word.

Texts are handled as UTF-8 bytes in slices of bounded size; a single text larger than the bound is a slice
of its own. Nulls are empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_BLOCK = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives the memory that it has freed back to the system when a task ends: workers wait for other tasks."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


#: ASCII A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True where a byte belongs to a word: all but space, tab, LF, VT, FF, CR.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: True for digits, ASCII letters and every byte of a multi-byte character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with at most `limit` bytes, or one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends of the words (bytes with inside[byte]) and, per text, the index of its first word (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[raw]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cut] = mask[cut]
    last[cut - 1] = mask[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    z = y >> np.uint64(27)
    y ^= z
    y *= np.uint64(0x94D049BB133111EB)
    np.right_shift(y, np.uint64(31), out=z)
    y ^= z
    return y


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        size = max(n, _BLOCK)
        for k, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


#: A random value for each byte at each of the first places of a word.
_NEAR = 64
_AT = mix(_BYTE[None, :] + np.arange(_NEAR, dtype=np.uint64)[:, None] * _P).ravel()


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: the sum of a random value for each byte and place, mixed with the length."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _BLOCK, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        first, last = starts[a:b] - lo, ends[a:b] - lo
        # the place in its word of each byte; those between words count on, and belong to none
        place = np.arange(hi - lo, dtype=np.int32) - np.repeat(first.astype(np.int32), np.diff(first, append=hi - lo))
        part = raw[lo:hi]
        values = _AT[np.minimum(place, _NEAR - 1) << 8 | part]
        if len(far := np.flatnonzero(place >= _NEAR)):
            values[far] = mix(_BYTE[part[far]] + place[far].astype(np.uint64) * _P)
        edges = np.empty(2 * (b - a), np.int64)
        edges[0::2], edges[1::2] = first, last
        sums = np.add.reduceat(np.append(values, np.uint64(0)), edges)[0::2]
        out[a:b] = mix(sums + (last - first).astype(np.uint64) * _P)
        a = b
    return out


def same_spans(items: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of the distinct spans of items, and for each span which of them it is.

    Spans with equal hashes are compared item by item with the one that stands for them; those that differ from it
    stand for themselves.
    """
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    other = size != size[one][which]
    copies = np.flatnonzero(~other & (one[which] != np.arange(len(starts))))
    for k in range(0, len(copies), 1 << 16):
        own = copies[k : k + (1 << 16)]
        n = size[own]
        cut = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(cut, n)
        differ = items[np.repeat(starts[own], n) + inside] != items[np.repeat(starts[one[which[own]]], n) + inside]
        if differ.any():
            other[own[np.unique(np.repeat(np.arange(len(own)), n)[differ])]] = True
    if len(alone := np.flatnonzero(other)):
        which = which.copy()
        which[alone] = len(one) + np.arange(len(alone))
        one = np.concatenate([one, alone])
    return one, which


def grams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of the n consecutive word hashes from each position on (len(words) - n + 1 of them)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(size, np.uint64(salt), np.uint64)
    for j in range(n):
        total = mix(total * _P + words[j : j + size]) if j == n - 1 else total * _P + words[j : j + size]
    return total


def digest_rows(sizes: np.ndarray, blob: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the next sizes[i] items of blob."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * blob.itemsize
    data = np.ascontiguousarray(blob)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


#: Code points below this have their hash in a table.
_TABLED = 0x3000
_POINT = mix(np.arange(_TABLED, dtype=np.uint64) + np.uint64(0x51))


def _point_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each code point."""
    if not len(points) or points.max() < _TABLED:
        return _POINT[points]
    out = _POINT[np.minimum(points, _TABLED - 1)]
    if len(far := np.flatnonzero(points >= _TABLED)):
        out[far] = mix(points[far].astype(np.uint64) + np.uint64(0x51))
    return out


class Spans:
    """Hashes of spans of a sequence of code points."""

    def __init__(self, points: np.ndarray, n: int) -> None:
        """n: the length of the runs that hashes are made of."""
        self.n, values = n, _point_hashes(points)
        powers, inverse = _powers(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        values *= powers[: len(points)]
        np.cumsum(values, out=self.sums[1:])
        self.inverse = inverse
        size = max(0, len(points) - n + 1)
        runs = self.sums[n:] - self.sums[:size] if size else np.zeros(0, np.uint64)
        runs *= inverse[:size]
        runs += np.uint64(n)
        #: The hash of the n code points from every place on.
        self.runs = mix(runs)

    def _polynomial(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Only for spans of a few code points: long ones can be made to collide."""
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each span: of one shorter than n from its code points, else the sum of a random value for each run of
        n, one after another and the last one at the end, and its number."""
        out = np.empty(len(starts), np.uint64)
        size = ends - starts
        short = size < self.n
        out[short] = self._polynomial(starts[short], ends[short])
        long = np.flatnonzero(~short)
        if len(long):
            runs = -(-size[long] // self.n)
            cut = np.cumsum(runs) - runs
            k = np.arange(int(runs.sum())) - np.repeat(cut, runs)
            at = np.repeat(starts[long], runs) + self.n * k
            at[cut + runs - 1] = ends[long] - self.n
            sums = np.add.reduceat(mix(self.runs[at] + k.astype(np.uint64) * _P), cut)
            out[long] = mix(sums + size[long].astype(np.uint64) * _P)
        return out
