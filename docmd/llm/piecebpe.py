"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text becomes pieces of a `.model` file: spaces become U+2581, one is put in front, and characters are merged
by score. No piece of such a file holds U+2581 after another character, so a text falls apart into units (a run
of U+2581 and the characters up to the next one) that are encoded on their own. All units of a slice (distinct
ones, at dropout 0) advance together: the agenda of a unit holds its candidate merges; the best one (score, then place) comes off
it, and a hash of the seed, the text, the unit, the unit's place in the text, the place and the two pieces says
whether it is skipped. A skipped candidate is gone; a merge beside it can bring up new ones. At dropout 0 this is the library's
encoding.

A text counts by a 64-bit hash of the seed and its bytes, so that one word is cut anew wherever it occurs, in one
text as in different ones, while equal texts stay equal and runs repeat. Characters without a piece, and any U+2581 of
the text itself, become byte pieces, so decoding gives the text back whatever was skipped. Null texts have null
pieces, empty texts none.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import unused
from docmd.llm.textvec import mix, same_spans, slices, tidy

SPACE = "▁"
DROPOUT, SEED = 0.1, 20240229
#: Bytes of text, and places of units, that are handled at once.
SLICE, PLACES = 1 << 19, 1 << 18
#: Characters of a unit from which its merges are not found by scanning it.
LONG = 2048
_NONE = np.int32(1 << 30)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            shift += 7
            at += 1
            if data[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """A piece file: pieces, and the merges as a hash table from two pieces to (rank, merged piece)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.pieces, scores, kinds = [], [], []
        for number, value in fields:
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, 1))
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (1, 4)}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces that span words are not supported")
        bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        self.byte_ids = np.array([bytes_[b] for b in range(256)], np.int32)
        self.byte_of = {i: b for b, i in bytes_.items()}
        self.chars = {p: i for p, i in normal.items() if len(p) == 1}
        # pieces that are no single piece but stand for a character on the way: none; every half must be a piece
        order = {i: r for r, (_, i) in enumerate(sorted((-scores[i], i) for i in normal.values()))}
        pairs = [(normal[p[:k]], normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        keys = np.array([a << 32 | b for a, b, _ in pairs], np.int64)
        size = 1 << (4 * len(keys)).bit_length()
        self.mask, self.keys = size - 1, np.full(size, -1, np.int64)
        self.ranks, self.merged = np.full(size, _NONE, np.int32), np.full(size, -1, np.int32)
        for key, (_, _, i) in zip(keys.tolist(), pairs, strict=True):
            at = int(mix(np.array([key], np.uint64))[0]) & self.mask
            while self.keys[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.ranks[at], self.merged[at] = key, order[i], i
        self.points = np.full(0x110000, -1, np.int32)
        for c, i in self.chars.items():
            self.points[ord(c)] = i

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each two pieces; _NONE and -1 where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = -2
        at = (mix(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            there = self.keys[at[todo]]
            todo = todo[(there != key[todo]) & (there >= 0)]
            at[todo] = at[todo] + 1 & self.mask
        return self.ranks[at], self.merged[at]


    def pair(self, left: int, right: int) -> tuple[int, int]:
        """The same for two pieces."""
        if left < 0 or right < 0:
            return int(_NONE), -1
        key = left << 32 | right
        at = _mixed(key) & self.mask
        while (there := int(self.keys[at])) != key and there >= 0:
            at = at + 1 & self.mask
        return int(self.ranks[at]), int(self.merged[at])


def _mixed(x: int) -> int:
    """`mix` of one number."""
    full = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
    x = (x ^ x >> 27) * 0x94D049BB133111EB & full
    return x ^ x >> 31


@cache
def load(path: str) -> Pieces:
    return Pieces(path)


def _merge(model: Pieces, ids: np.ndarray, hashes: np.ndarray, dropout: float) -> np.ndarray:
    """ids (units, places) of first pieces, -1 beyond the end or where a character has no piece (-2 - point); -1 where merged away."""
    units, width = ids.shape
    if width < 2 or not units:
        return ids
    limit = np.uint64(min(int(dropout * 2.0**64), (1 << 64) - 1))
    right = np.tile(np.arange(1, width + 1, dtype=np.int32), (units, 1))  # the next place that is left
    left = np.tile(np.arange(-1, width - 1, dtype=np.int32), (units, 1))
    ranks, merged = (x.reshape(units, width - 1) for x in model.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
    ranks, merged = ranks.copy(), merged.copy()
    live = np.flatnonzero((ranks < _NONE).any(1))
    while len(live):
        own = ranks[live]
        at = own.argmin(1)
        best = own[np.arange(len(live)), at]
        keep = best < _NONE
        live, at = live[keep], at[keep]
        if not len(live):
            break
        nxt = right[live, at]
        if dropout:
            key = mix(hashes[live] + (at.astype(np.uint64) + np.uint64(1)) * _ODD)
            key = mix(key ^ ((ids[live, at].astype(np.uint64) << np.uint64(32)) | ids[live, nxt].astype(np.uint64)))
            skip = key < limit
            ranks[live[skip], at[skip]] = _NONE
            r, a, n = live[~skip], at[~skip], nxt[~skip]
        else:
            r, a, n = live, at, nxt
        if len(r):
            ids[r, a] = merged[r, a]
            ids[r, n] = -1
            inner = n < width - 1
            ranks[r[inner], n[inner]] = _NONE
            after = right[r, n]
            right[r, a] = after
            has = after < width
            left[r[has], after[has]] = a[has]
            before = left[r, a]
            fresh = np.full(len(r), -1, np.int32)
            fresh[has] = ids[r[has], after[has]]
            rank, piece = model.pairs(ids[r, a], fresh)
            place = a < width - 1
            ranks[r[place], a[place]], merged[r[place], a[place]] = rank[place], piece[place]
            some = before >= 0
            rs, bs = r[some], before[some]
            rank, piece = model.pairs(ids[rs, bs], ids[rs, a[some]])
            ranks[rs, bs], merged[rs, bs] = rank, piece
    return ids


def _merge_long(model: Pieces, ids: np.ndarray, seed: int, dropout: float) -> np.ndarray:
    """`_merge` of one unit of many places: the best candidate comes off a heap."""
    n, full = len(ids), (1 << 64) - 1
    limit = min(int(dropout * 2.0**64), full)
    ranks, merged = (x.tolist() for x in model.pairs(ids[:-1], ids[1:]))
    out, none = ids.tolist(), int(_NONE)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(ranks) if r < none]
    heapify(heap)
    while heap:
        rank, at = heappop(heap)
        if ranks[at] != rank:  # another candidate by now
            continue
        nxt = right[at]
        if dropout:
            key = _mixed(seed + (at + 1) * int(_ODD) & full)
            if _mixed(key ^ (out[at] << 32 | out[nxt])) < limit:
                ranks[at] = none
                continue
        out[at], out[nxt] = merged[at], -1
        if nxt < n - 1:
            ranks[nxt] = none
        after = right[at] = right[nxt]
        if at < n - 1:
            ranks[at] = none
        if after < n:
            left[after] = at
            ranks[at], merged[at] = model.pair(out[at], out[after])
            if ranks[at] < none:
                heappush(heap, (ranks[at], at))
        if (before := left[at]) >= 0:
            ranks[before], merged[before] = model.pair(out[before], out[at])
            if ranks[before] < none:
                heappush(heap, (ranks[before], before))
    return np.array(out, np.int32)


def encode(path: str, texts: pa.Array, dropout: float = DROPOUT, seed: int = SEED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice: the piece ids of its texts and the offsets of the texts."""
    model = load(path)
    for first, end, raw, offsets in slices(texts, SLICE):
        data = raw.tobytes().decode("utf-8", "replace") if (offsets[1:] > offsets[:-1]).any() else ""
        points = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        if len(heads) != len(points):  # bytes that are not UTF-8
            fixed = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield from encode(path, pa.array(fixed), dropout, seed)
            continue
        at = np.searchsorted(heads, offsets)
        own = np.zeros(end - first, np.uint64)
        if dropout:
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                digest = hashlib.blake2b(raw[a:b].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
                own[i] = int.from_bytes(digest, "little")
        # one mark in front of every text that is not empty; the text's own marks get a code of their own
        some = np.flatnonzero(at[1:] > at[:-1])
        space, own_mark = ord(SPACE), 0x110000
        points = np.where(points == 0x20, space, np.where(points == space, own_mark, points)).astype(np.int64)
        points = np.insert(points, at[:-1][some], space)
        sizes = np.diff(at)
        sizes[some] += 1
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark = points == space
        begin = mark.copy()
        begin[1:] &= ~mark[:-1]
        begin[starts[:-1][some]] = True
        unit = np.flatnonzero(begin)
        ends = np.append(unit[1:], len(points))
        if not len(unit):
            yield np.zeros(0, np.int32), np.zeros(end - first + 1, np.int64)
            continue
        text = np.searchsorted(starts, unit, "right") - 1
        h = _unit_hashes(points, unit, ends)
        if dropout:
            place = np.arange(len(unit)) - np.searchsorted(text, text)
            h = mix(h ^ mix(own[text] + (place.astype(np.uint64) + np.uint64(1)) * _ODD))
            one = which = np.arange(len(unit))
        else:
            one, which = same_spans(points, h, unit, ends)
        pieces, counts = _units(model, points, unit[one], ends[one], mix(h[one] ^ np.uint64(seed)), dropout)
        where = np.concatenate([[0], np.cumsum(counts)])
        n = counts[which]
        total = np.concatenate([[0], np.cumsum(n)])
        out = pieces[np.repeat(where[which] - total[:-1], n) + np.arange(total[-1])]
        yield out, total[np.searchsorted(unit, starts)]


def _unit_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each unit; units follow one another."""
    place = np.arange(len(points), dtype=np.uint64)
    place -= np.repeat(starts.astype(np.uint64), np.diff(starts, append=len(points)))
    sums = np.add.reduceat(mix(points.astype(np.uint64) * _ODD + mix(place)), starts)
    return mix(sums + (ends - starts).astype(np.uint64) * _ODD)


def _units(model: Pieces, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of every unit, one after another, and how many each has."""
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    results: list = [None] * len(starts)
    counts = np.zeros(len(starts), np.int64)
    flat: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    a = 0
    while a < len(order):
        # units of like length together, about PLACES places at most
        width = int(sizes[order[a]])
        upto = max(width + 2, int(width * 1.25))
        b = min(int(np.searchsorted(sizes[order], upto, "right")), a + max(1, PLACES // upto))
        rows = order[a:b]
        width = int(sizes[order[b - 1]])
        at = starts[rows][:, None] + np.arange(width)
        inside = np.arange(width) < sizes[rows][:, None]
        codes = np.where(inside, points[np.minimum(at, len(points) - 1)], -1)
        ids = np.where(codes == 0x110000, -1, model.points[np.where((codes < 0) | (codes > 0x10FFFF), 0, codes)])
        ids = np.where(inside, np.where(ids < 0, -2 - codes, ids), -1).astype(np.int32)
        ids = np.stack([_merge_long(model, x, int(h), dropout) for x, h in zip(ids, hashes[rows], strict=True)]) if width > LONG else _merge(model, ids, hashes[rows], dropout)
        left = ids != -1
        left &= inside
        row, _ = np.nonzero(left)
        values = ids[left]
        if (values < -1).any():  # characters that become bytes
            odd = np.flatnonzero(values < -1)
            spelled = [SPACE.encode() if -2 - v == 0x110000 else chr(-2 - v).encode() for v in values[odd].tolist()]
            repeat = np.ones(len(values), np.int64)
            repeat[odd] = [len(x) for x in spelled]
            spread = np.repeat(values, repeat)
            spread[spread < -1] = model.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            values, row = spread, np.repeat(row, repeat)
        flat.append(values)
        owners.append(rows[row])
        a = b
    del results
    owner = np.concatenate(owners)
    back = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(starts))
    return np.concatenate(flat)[back], counts


def decode(path: str, ids: np.ndarray) -> str:
    """The text of some piece ids."""
    model = load(path)
    table = _spellings(path)
    text = b"".join([table[i] for i in ids.tolist()])
    del model
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


@cache
def _spellings(path: str) -> list[bytes]:
    model = load(path)
    return [bytes([model.byte_of[i]]) if i in model.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]


def encoded(rows: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """The kept columns and the piece ids of each text in `pieces`, which replaces a kept column of that name."""
    keep = [c for c in keep if c != "pieces"]
    own = unused(keep, "_text")
    slim = rows.select(*keep, F.col(text).alias(own))
    schema = rows.select(*keep).withColumn("pieces", F.lit(None).cast("array<int>")).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, nulls = 0, batch.column(own).is_null()
            for ids, at in encode(path, batch.column(own), dropout, seed):
                n = len(at) - 1
                none = nulls.slice(done, n).combine_chunks() if isinstance(nulls, pa.ChunkedArray) else pa.concat_arrays([nulls.slice(done, n)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=none)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(done, n) for c in keep), lists], [*keep, "pieces"])
                done += n

    return slim.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, pieces: str = "pieces", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the text of each list of pieces in `text`, which replaces a kept column of that name."""
    keep = [c for c in keep if c != "text"]
    own = unused(keep, "_pieces")
    slim = rows.select(*keep, F.col(pieces).alias(own))
    schema = rows.select(*keep).withColumn("text", F.lit(None).cast("string")).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(path, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(own)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return slim.mapInArrow(run, schema)


def round_trip(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """The kept columns, the pieces of each text, their number, whether they decode to the text, and the decoded
    text's SHA-256 (null for a null text). One pass encodes and decodes, a slice at a time."""
    names = ["pieces", "n_pieces", "lossless", "decoded_sha256"]
    keep = [c for c in keep if c not in names]
    own = unused(keep, "_text")
    slim = rows.select(*keep, F.col(text).alias(own))
    schema = rows.select(*keep).withColumns({"pieces": F.lit(None).cast("array<int>"), "n_pieces": F.lit(0), "lossless": F.lit(True), "decoded_sha256": F.lit(None).cast("string")}).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, texts = 0, batch.column(own)
            for ids, at in encode(path, texts, dropout, seed):
                n = len(at) - 1
                lossless, digests, nulls = [], [], []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    given = texts[done + i]
                    nulls.append(not given.is_valid)
                    back = decode(path, ids[a:b]).encode() if given.is_valid else None
                    lossless.append(back is None or back == given.as_buffer().to_pybytes())
                    digests.append(None if back is None else hashlib.sha256(back).hexdigest())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(nulls))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(done, n) for c in keep), lists, pa.array(np.diff(at), pa.int32()), pa.array(lossless), pa.array(digests, pa.string())], [*keep, *names])
                done += n

    return slim.mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
