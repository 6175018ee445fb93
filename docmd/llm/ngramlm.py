"""Interpolated modified Kneser-Ney model of any order from 2, counted in Spark, stored as sorted hash arrays that workers
map into memory.

Tokens are words (runs of anything but space, tab, LF, VT, FF, CR; ASCII lower-cased) and then one end; the
first word's context is a begin mark, which is no token. The steps:

1. Word counts: every task counts the hashes of its words, and sends them as sorted arrays by range of hash; a
   task for each range adds them up and writes one file: hashes, counts. A word's id is its place in all ranges.
2. For k = 2 to the order, counts of k-grams: the same with (place of the context, place of the suffix), the
   (k-1)-grams without the last and without the first word, in as few bits as they need and mixed within these, so that
   a frequent gram's longer ones spread over all ranges. The files hold the mixed pairs of places, sorted, as a directory
   of their high bits and 32 low bits each, and their counts, a byte each and the few larger ones aside; a k-gram's place
   is its place in all ranges. The two places must fit 64 bits; more grams of one length raise an error.
3. From the order down, for every place one below: how many of its longer grams count 1, 2, 3 or more, and the sum of their
   counts (for the longest grams that is its own count, as every word but an end has one after it); as a suffix its distinct contexts, which are its
   count from then on. Grams that start with the begin mark have nothing before them and keep their own count. For a gram
   that occurs once all of this is known, and not sent; the others' come as sums by range of places, one file for each range.
4. Discounts of all orders from counts of counts (a few sums).
5. Scoring: each slice's distinct words and grams are looked up in the mapped files by binary search.

P(w | h) = (max(c(hw) - D, 0) + g(h) P(w | h')) / c(h), g(h) the discounts taken in h, and h' being h without its
first word; below the pairs is Q(w), the same with 1 / (V + 1) for every word and the unknown one below it. A context
without longer grams leaves P(w | h'). A text's first words have as much context as there is from the begin mark on.
The words' 64-bit hashes stand for the words; grams of places are exact.

The files lie in the shared folder; where that is no mounted path, workers read them into memory instead of
mapping them. Every range's task writes under a name of its own and moves the file into place, so a repeated
task changes nothing. Null texts are empty: one end. Without training rows every word is unknown and P is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import discard, released, scratch_path, stored, unused
from docmd.llm.files import place, put
from docmd.llm.sampling import remainder
from docmd.llm.textvec import LOWER, NOT_SPACE, slices, tidy, word_hashes, word_spans

END = np.uint64(0x5D588B656C078965)
FLUSH = 1 << 22
UNKNOWN = np.int64(-1)
#: The order of the query's model.
ORDER = 3
_FOUR = 4


def write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """One file of arrays, one after another, each from a multiple of 8 bytes on, with their lengths before them."""
    parts = [np.array([len(a) for a in arrays], np.int64).data]
    for a in arrays:
        parts += [np.ascontiguousarray(a).data, b"\0" * (-a.nbytes % 8)]
    put(path, parts)


def _views(raw: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
    k, out = 8 * len(kinds), []
    for kind, n in zip(kinds, raw[:k].view(np.int64).tolist(), strict=True):
        size = n * np.dtype(kind).itemsize
        out.append(raw[k : k + size].view(kind))
        k += size + -size % 8
    return out


@lru_cache(4096)
def _mapped(path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    return _views(np.memmap(path, np.uint8, "r").view(np.ndarray), kinds)


@lru_cache(16)
def _loaded(path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    store, at = place(path)
    return _views(np.frombuffer(store.open_input_file(at).read(), np.uint8), kinds)


def read_arrays(path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory where its file system is a mounted one; else a few files are held."""
    store, at = place(path)
    return _mapped(at, kinds) if isinstance(store, fs.LocalFileSystem) else _loaded(path, kinds)


#: A count is a byte; of those from LARGE on the places and values follow.
COUNT = ("uint8", "uint32", "int64")
LARGE = 255
#: Low bits of a key that are stored for each one.
LOW = 32
PLAIN = -1
#: Keys for each value of the high bits from which the runs of low bits are searched one by one.
SEARCHED = 64


def packed_counts(counts: np.ndarray) -> list[np.ndarray]:
    large = np.flatnonzero(counts >= LARGE)
    return [np.minimum(counts, LARGE).astype(np.uint8), large.astype(np.uint32), counts[large].astype(np.int64)]


def packed_keys(keys: np.ndarray, first: int, end: int) -> list[np.ndarray]:
    """The sorted keys of a range, from first to before end: where each value of the high bits begins, and the low bits."""
    high = np.arange((first >> LOW), ((end - 1) >> LOW) + 2, dtype=np.uint64)
    return [np.searchsorted(keys >> np.uint64(LOW), high).astype(np.uint32), keys.astype(np.uint32)]


@dataclass
class Ranges:
    """Files over equal ranges of keys of so many bits; sizes has the keys of each."""

    path: str
    kinds: tuple[str, ...]
    sizes: list[int]
    bits: int = 64
    counts: int = PLAIN  # the first array of packed counts

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def shard(self, i: int) -> list[np.ndarray]:
        return read_arrays(f"{self.path}/{i:06d}", self.kinds) if self.sizes[i] else [np.zeros(0, k) for k in self.kinds]

    def count(self, i: int, field: int) -> np.ndarray:
        """All counts of a range."""
        if self.counts == PLAIN:
            return self.shard(i)[field]
        few, at, value = self.shard(i)[self.counts + 3 * field : self.counts + 3 * field + 3]
        out = few.astype(np.int64)
        out[at] = value
        return out

    def keys(self, i: int) -> np.ndarray:
        """All keys of a range."""
        found = self.shard(i)
        if self.counts == PLAIN:
            return found[0]
        if not self.sizes[i]:
            return np.zeros(0, np.uint64)
        high = np.repeat(np.arange(len(found[0]) - 1, dtype=np.uint64), np.diff(found[0].astype(np.int64)))
        return (high + (edges(len(self.sizes), self.bits)[i] >> np.uint64(LOW)) << np.uint64(LOW)) | found[1].astype(np.uint64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each of the sorted keys, -1 where it isn't."""
        out = np.full(len(keys), UNKNOWN)
        first = edges(len(self.sizes), self.bits)
        starts, own = self.starts, np.append(np.searchsorted(keys, first), len(keys))
        for i, n in enumerate(self.sizes):
            a, b = own[i], own[i + 1]
            if not n or b <= a:
                continue
            wanted, found = keys[a:b], self.shard(i)
            if self.counts == PLAIN:
                at = np.minimum(np.searchsorted(found[0], wanted), n - 1)
                same = found[0][at] == wanted
            else:
                high = ((wanted >> np.uint64(LOW)) - (first[i] >> np.uint64(LOW))).astype(np.int64)
                low, values = wanted.astype(np.uint32), found[1]
                at, end = found[0][high].astype(np.int64), found[0][high + 1].astype(np.int64)
                if SEARCHED * len(found[0]) < len(wanted):  # a few long runs of low bits: each is searched at once
                    cuts = np.append(np.flatnonzero(np.diff(high, prepend=-1)), len(wanted))
                    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        at[x:y] += np.searchsorted(values[at[x] : end[x]], low[x:y])
                else:
                    for step in (1 << k for k in reversed(range(int((end - at).max()).bit_length()))):
                        probe = at + (step - 1)
                        less = probe < end
                        less &= values[np.minimum(probe, n - 1, out=probe)] < low
                        at += less * np.int64(step)
                same = (at < end) & (values[np.minimum(at, n - 1)] == low)
            out[a:b] = np.where(same, starts[i] + at, UNKNOWN)
        return out

    def take(self, field: int, places: np.ndarray) -> np.ndarray:
        """A count at each of the places, which are sorted but for -1 anywhere among them; 0 at -1."""
        out = np.zeros(len(places), np.int64)
        some = np.flatnonzero(places >= 0)
        known, starts = places[some], self.starts
        own = np.searchsorted(known, starts)
        for i in range(len(self.sizes)):
            a, b = own[i], own[i + 1]
            if b <= a:
                continue
            at = known[a:b] - starts[i]
            if self.counts == PLAIN:
                out[some[a:b]] = self.shard(i)[field][at]
                continue
            few, large, value = self.shard(i)[self.counts + 3 * field : self.counts + 3 * field + 3]
            got = few[at].astype(np.int64)
            if len(more := np.flatnonzero(got == LARGE)):
                got[more] = value[np.searchsorted(large, at[more])]
            out[some[a:b]] = got
        return out


def edges(n: int, bits: int = 64) -> np.ndarray:
    """The first key of each of n equal ranges."""
    return np.array([(i << bits) // n for i in range(n)], np.uint64)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of the rows of values (n, fields) of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(values, at, axis=0) if len(at) else values


def _steps(sorted_: np.ndarray, first: int) -> bytes:
    """Sorted numbers from first on as steps: a byte for their width, then a byte of all steps after another, which compresses well."""
    steps = np.diff(sorted_, prepend=np.uint64(first))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_steps(blob: pa.Buffer, first: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    width = int(raw[0])
    steps = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    steps[:, :width] = raw[1:].reshape(width, -1).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + np.uint64(first)


def _parts(keys: np.ndarray, counts: np.ndarray, ranges: int, bits: int) -> pa.RecordBatch | None:
    """Sorted keys and their counts as rows (part, keys, counts); a count is a byte, a larger one several entries."""
    if not len(keys):
        return None
    times = -(-counts // 255)
    if (times > 1).any():
        small = np.repeat(np.minimum(counts, 255), times)
        last = np.cumsum(times) - 1
        small[last] = counts - (times - 1) * 255
        keys, counts = np.repeat(keys, times), small
    first = edges(ranges, bits)
    at = np.append(np.searchsorted(keys, first), len(keys))
    some = [i for i in range(ranges) if at[i + 1] > at[i]]
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([_steps(keys[at[i] : at[i + 1]], int(first[i])) for i in some], pa.binary()), pa.array([counts[at[i] : at[i + 1]].astype(np.uint8).tobytes() for i in some], pa.binary())],
        ["part", "keys", "counts"],
    )


def _counted(streams: Iterator[np.ndarray], ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The counts of all keys of the streams, flushed whenever more than FLUSH distinct ones are held."""
    held, size = [], 0
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, 1), np.int64)
    for more in streams:
        one, n = np.unique(more, return_counts=True)
        held.append((one, n[:, None]))
        size += len(one)
        if size > FLUSH // 2:
            keys, counts = summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([counts, *(c for _, c in held)]))
            held, size = [], 0
            if len(keys) > FLUSH:
                yield _parts(keys, counts[:, 0], ranges, bits)
                keys, counts = keys[:0], counts[:0]
    keys, counts = summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([counts, *(c for _, c in held)]))
    if len(keys):
        yield _parts(keys, counts[:, 0], ranges, bits)


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice: the token hashes of its texts (each with its end) and the offsets of the texts."""
    for _, _, raw, offsets in slices(texts):
        raw = LOWER[raw]
        starts, ends, words = word_spans(raw, offsets, NOT_SPACE)
        n = np.diff(words)
        at = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(at[-1], END, np.uint64)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        out[inside] = word_hashes(raw, starts, ends)
        yield out, at


@dataclass
class Places:
    """Places of tokens: the distinct ones, sorted from UNKNOWN on, and which of them each token has."""

    distinct: np.ndarray
    which: np.ndarray

    @staticmethod
    def of(found: np.ndarray, where: np.ndarray) -> "Places":
        """found: the places of sorted keys, so that the known ones ascend; where: which key each token has."""
        known = found >= 0
        return Places(np.append(UNKNOWN, found[known]), np.where(known, np.cumsum(known), 0)[where])

    @property
    def each(self) -> np.ndarray:
        return self.distinct[self.which]

    def preceding(self, offsets: np.ndarray, first: int) -> "Places":
        """The place before each one in its text; before a text's first one `first`, UNKNOWN or above all places."""
        if first == UNKNOWN:
            return Places(self.distinct, preceding(self.which, offsets, 0))
        return Places(np.append(self.distinct, first), preceding(self.which, offsets, len(self.distinct)))


@dataclass
class Model:
    words: Ranges  # hash, count
    grams: list[Ranges]  # of 2 words and more: mixed (place of the context, place of the suffix), count
    stats: list[Ranges]  # of 1 word and more, by place: how many of its longer grams count 1, 2, 3 and more; its own count; but for the last, the sum of their counts
    total: int  # training tokens
    texts: int  # training texts
    discounts: list[np.ndarray]  # of 1 word and more, by count, 0 to 3
    contexts: int  # distinct pairs
    left: float  # the share of the words' distribution that is spread evenly

    @property
    def size(self) -> int:
        return int(sum(self.words.sizes))

    def look_up(self, hashes: np.ndarray) -> "Places":
        """The id of each hash."""
        one, where = np.unique(hashes, return_inverse=True)
        return Places.of(self.words.find(one), where)


def _width(model: Model, k: int) -> int:
    """The bits that a place of a gram of k words takes, or the begin mark's, one after the words' last."""
    return max(1, (model.size if k == 1 else sum(model.grams[k - 2].sizes)).bit_length())


_FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def scrambled(x: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    """A one-to-one mixture of numbers of so many bits, or back."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for f in reversed(_FACTORS) if back else _FACTORS:
        if back:
            x = x ^ (x >> half)
            x = x * np.uint64(pow(f, -1, 1 << 64)) & mask
        else:
            x = x * np.uint64(f) & mask
            x = x ^ (x >> half)
    return x


def gram_keys(places: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    """The key of the gram of each two places of so many bits."""
    return scrambled(before.astype(np.uint64) << np.uint64(width) | places.astype(np.uint64), 2 * width)


def gram_places(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the context and of the suffix of each key."""
    both = scrambled(keys, 2 * width, True)
    return (both >> np.uint64(width)).astype(np.int64), (both & np.uint64((1 << width) - 1)).astype(np.int64)


def preceding(places: np.ndarray, offsets: np.ndarray, first: int) -> np.ndarray:
    """The place before each one in its text; first before a text's first one."""
    before = np.empty_like(places)
    before[1:] = places[:-1]
    before[offsets[:-1]] = first
    return before


def climb(model: Model, ids: Places, offsets: np.ndarray) -> Iterator[tuple[Places, Places, np.ndarray]]:
    """For grams of 2 words and more up to one longer than the model's: the place of the context and of the suffix at each
    token (-1: not in the model), and which tokens have that many words since the begin mark."""
    places, inside = ids, np.ones(len(ids.which), bool)
    for k in range(len(model.grams) + 1):
        before = places.preceding(offsets, UNKNOWN if k else model.size)
        if k:
            at = offsets[:-1] + k - 1
            inside = inside.copy()
            inside[at[at < offsets[1:]]] = False
        yield before, places, inside
        if k < len(model.grams):
            known = np.flatnonzero((before.which > 0) & (places.which > 0) & inside)
            one, back = np.unique(gram_keys(places.each[known], before.each[known], _width(model, k + 1)), return_inverse=True)
            found = Places.of(model.grams[k].find(one), back)
            places = Places(found.distinct, np.zeros(len(inside), np.int64))
            places.which[known] = found.which


def discounts(n: list[int], positive: bool = False) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of entries that count 1, 2, 3, 4; 0.5 where one of them is missing;
    positive: also where a discount is not above 0, so that every context leaves something to unseen words."""
    if min(n) <= 0:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    found = [min(k - (k + 1) * y * n[k] / n[k - 1], k) for k in (1, 2, 3)]
    return np.array([0, *(d if d > 0 else 0.5 if positive else 0 for d in found)])


def _collect(table: pa.Table, ranges: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    first = int(edges(ranges, bits)[table["part"][0].as_py()])
    keys = np.concatenate([_from_steps(x.as_buffer(), first) for c in table["keys"].chunks for x in c])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for c in table["counts"].chunks for x in c])
    keys, sums = summed(keys, counts.astype(np.int64)[:, None])
    return keys, sums[:, 0]


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, _FOUR + 1), minlength=_FOUR + 2)[1 : _FOUR + 1].tolist()


def _planes(fields: list[np.ndarray]) -> bytes:
    """Arrays of equal length, a byte of all entries after another, which compresses well."""
    kind = np.uint32 if all(f.max(initial=0) < 1 << 32 for f in fields) else np.uint64
    return b"".join(np.ascontiguousarray(f.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes() for f in fields)


def _fields(blob: pa.Buffer, n: int, fields: int) -> list[np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    width = len(raw) // (fields * n)
    return [np.ascontiguousarray(x.T).view(f"u{width}").ravel().astype(np.int64) for x in raw.reshape(fields, width, n)]


_SUMS = "part int, own int, n_contexts long, contexts binary, n_suffixes long, suffixes binary, n long, ns array<long>, more long"


def _sums(part: int, context: np.ndarray, suffix: np.ndarray, counts: np.ndarray, level: Ranges, begin: int | None, longest: bool) -> pa.Table:
    """What grams of these places and counts add to those of level, one word shorter, by range; one row at least. begin: the place
    of the begin mark, which has a range of its own; where there is none, grams that occur once are left out. Those of the longest
    grams have no sum of counts."""
    starts = level.starts if begin is None else np.append(level.starts, begin + 1)
    sides = [summed(context, np.stack([counts == 1, counts == 2, counts >= 3, *([] if longest else [counts])], 1).astype(np.int64)), summed(suffix, np.ones((len(suffix), 1), np.int64))]
    if begin is None:
        sides = [(ids[again], sums[again]) for ids, sums in sides for again in [level.take(0, ids) > 1]]
    cuts = [np.searchsorted(ids, starts) for ids, _ in sides]
    some = [i for i in range(len(starts) - 1) if any(at[i + 1] > at[i] for at in cuts)] or [0]
    blobs = [[_planes([np.diff(ids[at[i] : at[i + 1]], prepend=starts[i]), *sums[at[i] : at[i + 1]].T]) for i in some] for (ids, sums), at in zip(sides, cuts, strict=True)]
    sizes = [[int(at[i + 1] - at[i]) for i in some] for at in cuts]
    n = len(some)
    return pa.table({
        "part": pa.array([part] * n, pa.int32()), "own": pa.array(some, pa.int32()), "n_contexts": pa.array(sizes[0], pa.int64()), "contexts": pa.array(blobs[0], pa.binary()),
        "n_suffixes": pa.array(sizes[1], pa.int64()), "suffixes": pa.array(blobs[1], pa.binary()), "n": pa.array([len(counts)] * n, pa.int64()),
        "ns": pa.array([_of_counts(counts)] * n, pa.list_(pa.int64())), "more": pa.array([int((counts > 2).sum())] * n, pa.int64()),
    })


def _added(table: pa.Table, size: int, longest: bool) -> np.ndarray:
    """(size, 4) or (size, 5) of what the rows of _sums add to the places of their range."""
    columns = {"contexts": [0, 1, 2] if longest else [0, 1, 2, 4], "suffixes": [3]}
    dense = np.zeros((size, 4 if longest else 5), np.int64)
    for r in range(len(table)):
        for name, fields in columns.items():
            if n := table[f"n_{name}"][r].as_py():
                at, *values = _fields(table[name][r].as_buffer(), n, len(fields) + 1)
                dense[np.cumsum(at)[:, None], fields] += np.stack(values, 1)
    return dense


def fit(rows: DataFrame, text: str = "text", order: int = 2) -> Model:
    """A model of the texts of all rows, of grams of up to `order` words."""
    if order < 2:
        raise ValueError("the order must be 2 at least")
    spark = rows.sparkSession
    texts = rows.select(F.col(text).alias("t"))
    ranges = 2 * max(4, texts.rdd.getNumPartitions())
    path = scratch_path(spark, "ngram")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted((h for b in batches for h, _ in tokens(b.column("t"))), ranges, 64)

    def writer(name: str, n: int, bits: int, packed: bool):
        def write(table: pa.Table) -> pa.Table:
            part = table["part"][0].as_py()
            keys, counts = _collect(table, n, bits)
            write_arrays(f"{path}/{name}/{part:06d}", [*packed_keys(keys, *_ends(part, n, bits)), *packed_counts(counts)] if packed else [keys, counts])
            ends = int(counts[keys == END].sum()) if not packed else 0
            return pa.table({"part": pa.array([part], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())], "ends": [ends]})

        return write

    sent, sizes = "part int, keys binary, counts binary", "part int, n long, total long, ends long"
    done = texts.mapInArrow(count_words, sent).groupBy("part").applyInArrow(writer("words", ranges, 64, False), sizes).collect()  # a row for each range
    words = Ranges(f"{path}/words", ("uint64", "int64"), [0] * ranges)
    for r in done:
        words.sizes[r.part] = r.n
    model = Model(words, [], [], sum(r.total for r in done), sum(r.ends for r in done), [], 0, 1.0)
    wide = 2 * ranges

    def counter(known: Model, bits: int):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def keys() -> Iterator[np.ndarray]:
                for b in batches:
                    for h, at in tokens(b.column("t")):
                        *_, (before, places, inside) = climb(known, known.look_up(h), at)
                        yield gram_keys(places.each[inside], before.each[inside], bits // 2)

            yield from _counted(keys(), wide, bits)

        return run

    def top(known: Model, bits: int):
        below, begin = (known.grams[-1], None) if known.grams else (known.words, known.size)

        def write(table: pa.Table) -> pa.Table:
            part = table["part"][0].as_py()
            keys, counts = _collect(table, wide, bits)
            write_arrays(f"{path}/{order}/{part:06d}", [*packed_keys(keys, *_ends(part, wide, bits)), *packed_counts(counts)])
            return _sums(part, *gram_places(keys, bits // 2), counts, below, begin, True)

        return write

    def middle(known: Model, k: int):
        level = known.grams[k - 2]
        below, begin = (known.grams[k - 3], None) if k > 2 else (known.words, known.size)

        def write(table: pa.Table) -> pa.Table:
            part = table["own"][0].as_py()
            dense, keys, counts = _added(table, level.sizes[part], k + 1 == order), level.keys(part), level.count(part, 0)
            dense[counts == 1] = (1, 0, 0, 1, 1)[: dense.shape[1]]
            dense[:, 3] = np.where(dense[:, 3] > 0, dense[:, 3], counts)
            write_arrays(f"{path}/stats{k}/{part:06d}", [x for j in range(dense.shape[1]) for x in packed_counts(dense[:, j])])
            return _sums(part, *gram_places(keys, level.bits // 2), dense[:, 3], below, begin, False)

        return write

    def low(table: pa.Table) -> pa.Table:
        part = table["own"][0].as_py()
        dense = _added(table, 1 if part == ranges else words.sizes[part], order == 2)
        write_arrays(f"{path}/stats1/{part:06d}", list(dense.T))
        own = dense[dense[:, 3] > 0, 3]
        return pa.table({"ns": pa.array([_of_counts(own)], pa.list_(pa.int64())), "more": [int((own > 2).sum())]})

    for k in range(2, order + 1):
        bits = 2 * _width(model, k - 1)
        if bits > 64:
            raise ValueError(f"more than 2^32 grams of {k - 1} words")
        shuffled = texts.mapInArrow(counter(model, bits), sent).groupBy("part")
        level = Ranges(f"{path}/{k}", ("uint32", "uint32", *COUNT), [0] * wide, bits, 2)
        if k < order:
            for r in shuffled.applyInArrow(writer(str(k), wide, bits, True), sizes).collect():
                level.sizes[r.part] = r.n
            released(spark)
            model = replace(model, grams=[*model.grams, level])
    made = shuffled.applyInArrow(top(model, bits), _SUMS)
    cuts = [np.zeros(4)] * order
    stats: list[Ranges] = []
    held = None
    for k in range(order, 1, -1):  # the grams of k words, and what they add to those of k - 1
        last, held = held, stored(made, "ngram-sums")
        released(spark) if last is None else discard(last)
        made, ns = held, np.zeros(_FOUR, int)
        for r in made.select("part", "n", "ns").distinct().collect():  # a row for each range
            if k == order:
                level.sizes[r.part] = r.n
            ns += r.ns
        cuts[k - 1] = discounts(ns.tolist(), order > 2)
        if k > 2:
            own = model.grams[k - 3]
            stats.insert(0, Ranges(f"{path}/stats{k - 1}", COUNT * (4 if k == order else 5), own.sizes, own.bits, 0))
            # every range has a row, also one of which no gram has a longer one
            each = [(-1, i, 0, b"", 0, b"", 0, [0] * _FOUR, 0) for i, n in enumerate(own.sizes) if n]
            made = made.unionByName(spark.createDataFrame(each, _SUMS)).groupBy("own").applyInArrow(middle(model, k - 1), _SUMS)
    wns, many = np.zeros(_FOUR, int), 0
    # an id without a pair does not exist: every word is a word or an end after some context
    for r in made.where("n > 0").groupBy("own").applyInArrow(low, "ns array<long>, more long").collect():
        wns += r.ns
        many += r.more
    discard(held)
    grams = [*model.grams, level]
    contexts = sum(grams[0].sizes)
    cuts[0] = discounts(wns.tolist(), order > 2)
    left = float(cuts[0][1] * wns[0] + cuts[0][2] * wns[1] + cuts[0][3] * many) / contexts if contexts else 1.0
    ids = Ranges(f"{path}/stats1", ("int64",) * (4 if order == 2 else 5), [*words.sizes, 1] if contexts else [0] * (ranges + 1))
    return replace(model, grams=grams, stats=[ids, *stats], discounts=cuts, contexts=contexts, left=left)


def _ends(part: int, n: int, bits: int) -> tuple[int, int]:
    """The first key of a range, and that of the next."""
    return (part << bits) // n, (part + 1 << bits) // n


def score(model: Model, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice, per text: tokens, known tokens, base score and the model's log10 probability."""
    size, even = model.size, 1 / (model.size + 1)
    for hashes, at in tokens(texts):
        ids = model.look_up(hashes)
        counts = model.words.take(1, ids.distinct)[ids.which]
        base = np.log10((counts + 1) / (model.total + size + 1))
        seen = model.stats[0].take(3, ids.distinct)
        p = (np.maximum(seen - model.discounts[0][np.minimum(seen, 3)], 0) / max(model.contexts, 1) + model.left * even)[ids.which]
        steps = climb(model, ids, at)
        before, _, inside = next(steps)
        for k in range(len(model.grams)):
            following = next(steps)
            # the grams' own counts: as they were counted for the longest ones
            places, back = following[1].distinct, following[1].which
            c = (model.stats[k + 1].take(3, places) if k + 1 < len(model.stats) else model.grams[k].take(0, places))[back]
            d = model.discounts[k + 1]
            contexts, which = before.distinct, before.which
            there = contexts if k else np.where(contexts == size, int(model.stats[0].starts[-2]), contexts)
            n = [model.stats[k].take(j, there) for j in range(3)]
            if k + 1 < len(model.grams):
                sums = model.stats[k].take(4, there)[which]
            else:
                sums = (model.grams[k - 1].take(0, contexts) if k else np.where(contexts == size, model.texts, model.words.take(1, np.where(contexts == size, UNKNOWN, contexts))))[which]
            given = (d[1] * n[0] + d[2] * n[1] + d[3] * n[2])[which]
            with np.errstate(divide="ignore", invalid="ignore"):
                longer = (np.maximum(c - d[np.minimum(c, 3)], 0) + given * p) / sums
            p = np.where(inside & (sums > 0), longer, p)
            before, _, inside = following
        starts = at[:-1]
        yield np.diff(at), np.add.reduceat(counts > 0, starts, dtype=np.int64), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def predict(rows: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, n_known, base_score, score and perplexity, which replace kept columns of their names."""
    names = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    keep = [c for c in keep if c not in names]
    own_text = unused(keep, "_text")
    slim = rows.select(*keep, F.col(text).alias(own_text))
    whole, real = F.lit(0).cast("long"), F.lit(0.0)
    schema = rows.select(*keep).withColumns(dict(zip(names, (whole, whole, real, real, real), strict=True))).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(score(model, batch.column(own_text)))
            if got:
                n, known, base, own = (np.concatenate(x) for x in zip(*got, strict=True))
                found = [n, known, base, own, 10 ** np.minimum(-own / n, 300)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, found)], [*keep, *names])

    return slim.mapInArrow(run, schema)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents.where(~F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))), order=ORDER)
    return predict(documents, model).select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
