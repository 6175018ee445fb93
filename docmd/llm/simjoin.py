"""Set similarity at scale: from band keys of items to components of items whose sets are similar.

The items' sets are hashed (64 bits a member). The steps, shared by documents and lines:

1. Items with equal sets are one class (a partial aggregate over a 128-bit digest); only the class's smallest
   id goes on.
2. Banded minima give keys; the items of a key are a bucket. The sets of items in a bucket with others are written
   once.
3. A few rounds, until one confirms nothing: every bucket names a leader, and every item is verified against a few leaders of its buckets that
   it is not connected with yet. The confirmed links are contracted; buckets of one component are done. A group of
   m near copies costs about m comparisons, not m * m.
4. In the buckets that still hold several components, all pairs of different components are verified, in tiles: a
   bucket is cut into blocks of bounded items and members, and every two blocks are a tile, which is one task's work and
   bounded in memory. A component that fills a block has blocks of its own, which never meet each other.

So every pair that shares a band key is verified or already connected by confirmed links; the callers state with which
probability a pair at the threshold shares one. Where sets are verified, packed b-bit signatures are compared by
counting bits; the pairs whose corrected estimate is within a margin of the threshold, and those of two sets that are
small, are confirmed on the full sets; every task returns a spanning forest of its confirmed links.

What stays quadratic is a bucket of many items that are similar to none of its other items, as the definition wants
each of those pairs verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmd.llm.common import connected_components, discard, lookup, stored
from docmd.llm.textvec import tidy

BLOCK = 512
BLOCK_MEMBERS = 1 << 20
#: Rounds of leaders; leaders that an item is verified against in one after the first.
ROUNDS, LEADERS = 3, 4
BITS = 2
MARGIN = 0.18
_EVEN = np.uint64(0x5555555555555555)
#: Bytes of payloads that are decoded at once, unless one tile has more; tiles of so few items are compared without an estimate.
DECODED, FEW = 1 << 19, 16
#: Buckets of so many items at most go to the task of their leader; it leads one for each band at most.
HOME = 16
#: The sorted sets of a column of payloads, and what gives the packed signatures of those at some places.
Decode = Callable[[pa.Array], tuple[list[np.ndarray], Callable[[np.ndarray], np.ndarray]]]


def set_digest(members: np.ndarray) -> bytes:
    """128 bits of a set of hashes, which must be distinct."""
    twisted = (members ^ (members >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    twisted ^= twisted >> np.uint64(32)
    return np.array([twisted.sum(dtype=np.uint64) + np.uint64(len(members)), np.bitwise_xor.reduce(twisted * np.uint64(0x94D049BB133111EB))], np.uint64).tobytes()


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """int64 keys (items, bands) of minima (items, bands * rows)."""
    items, k = minima.shape
    m = minima.reshape(items, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(k // rows, dtype=np.uint64) + np.uint64(1), m.shape[:2]).copy()
    for j in range(rows):
        key = (key ^ m[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def pack(minima: np.ndarray) -> np.ndarray:
    """The low BITS (2) bits of each minimum, 32 to a 64-bit word; places beyond the last minimum are 0."""
    items, k = minima.shape
    words = -(-k // 32)
    low = np.zeros((items, words * 32), np.uint64)
    low[:, :k] = minima & np.uint32(3)
    shifts = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return np.bitwise_or.reduce(low.reshape(items, words, 32) << shifts, axis=2)


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Similarity of every row of a with every row of b: equal places by bit counts, less those equal by chance."""
    differ = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        x = a[:, w][:, None] ^ b[:, w][None, :]
        differ += np.bitwise_count((x | x >> np.uint64(1)) & _EVEN)
    chance = 1 / (1 << BITS)
    return ((1 - differ / k) - chance) / (1 - chance)


def classes(signatures: DataFrame) -> DataFrame:
    """(digest, rep, class_size) of signatures (id, digest, ...)."""
    return signatures.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("class_size"))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = b.searchsorted(a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def similar(ids: np.ndarray, blocks: np.ndarray, whole: bool, sets: list[np.ndarray], packed: Callable[[], np.ndarray], percent: int, k: int, margin: float, small: int = 0, parts: np.ndarray | None = None, known: tuple[dict, set, list[int]] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of one tile; its rows are sorted by block. whole: the tile is one block.

    packed gives the packed signatures. parts: the component that each item is known to be in, by the id of an item; only
    pairs of different ones are compared. known: what tiles before this one found (links, and pairs of sets that are not
    similar), which this one adds to, and the numbers of the sets.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    split = 0 if whole else int(np.searchsorted(blocks, blocks[-1]))  # the rows before split are the first block
    root, refuted, number = known or ({}, set(), list(range(n)))
    names = ids.tolist()
    out = []

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            v = up
        return v

    def join(u: int, v: int) -> bool:
        if (p := find(u)) != (q := find(v)):
            root[max(p, q)] = min(p, q)
        return p != q

    if parts is not None:
        for v, part in zip(names, parts.tolist(), strict=True):
            join(v, part)
    if n <= FEW or split == 1:
        sizes = size.tolist()
        for u in range(n if whole else split):
            for v in range(u + 1 if whole else split, n):
                if 100 * min(sizes[u], sizes[v]) >= percent * max(sizes[u], sizes[v]) and (number[u], number[v]) not in refuted and find(names[u]) != find(names[v]):
                    both = _shared(sets[u], sets[v])
                    if 100 * both < percent * (sizes[u] + sizes[v] - both):
                        refuted.add((number[u], number[v]))
                    elif join(names[u], names[v]):
                        out.append((names[u], names[v]))
        return out
    a, b = (np.arange(n), np.arange(n)) if whole else (np.arange(split), np.arange(split, n))
    # sets of similar items have similar sizes
    close = 100 * np.minimum(size[a][:, None], size[b][None, :]) >= percent * np.maximum(size[a][:, None], size[b][None, :])
    if whole:
        close &= np.arange(n)[:, None] < np.arange(n)[None, :]
    roots = np.array([find(v) for v in names])
    close &= roots[a][:, None] != roots[b][None, :]
    if not close.any():
        return []
    bits = packed()
    near = estimate(bits[a], bits[b], k) >= percent / 100 - margin
    near |= (size[a] <= small)[:, None] & (size[b] <= small)[None, :]
    x, y = np.nonzero(close & near)
    x, y = a[x], b[y]
    if not len(x):
        return []
    used = np.unique(np.concatenate([x, y]))
    both = _common(sets, used)[np.searchsorted(used, x), np.searchsorted(used, y)]
    linked = 100 * both >= percent * (size[x] + size[y] - both)
    for u, v in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
        if join(names[u], names[v]):
            out.append((names[u], names[v]))
    return out


def _common(sets: list[np.ndarray], used: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of the used sets: a product of their 0/1 matrix, some columns at a time."""
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    members = np.concatenate([sets[u] for u in used])
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    first = np.ones(len(members), bool)
    first[1:] = members[1:] != members[:-1]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1]
    out = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(used), min(width, int(column[-1]) + 1 - a)), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    np.fill_diagonal(out, 0)
    return np.rint(out).astype(np.int64)


_TILE = "home", "i", "j", "group"


def links(rows: DataFrame, decode: Decode, percent: int, k: int, margin: float = MARGIN, small: int = 0) -> DataFrame:
    """(src, dst): spanning forests of the confirmed links of all tiles; rows: (home, group, i, j, side, id, part, payload).

    Tiles of one home meet in a task, one after another, so that a set is decoded once for many of them, and a pair that is
    connected or refuted isn't compared again. A tile is (group, i, j). With i = j its items are compared with each other, else those of side 0 with those of
    side 1; items of one part are not. A task reads its tiles one after another, sorted, and holds one of them at a time.
    """
    ordered = rows.repartition("home", "i", "j").sortWithinPartitions(*_TILE, "side", "id")

    def found(table: pa.RecordBatch) -> list[tuple[int, int]]:
        """The links of some whole tiles."""
        key = np.stack([table.column(c).to_numpy() for c in _TILE], 1)
        ids, side, parts = (table.column(c).to_numpy() for c in ("id", "side", "part"))
        payloads = table.column("payload")
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        weight = np.concatenate([[0], np.cumsum(pa.compute.binary_length(payloads).to_numpy(zero_copy_only=False))])
        out: list[tuple[int, int]] = []
        t = 0
        while t < len(cuts) - 1:
            u = max(t + 1, int(np.searchsorted(weight[cuts], weight[cuts[t]] + DECODED, "right")) - 1)
            first = cuts[t]
            coded = payloads.slice(first, cuts[u] - first).dictionary_encode()
            sets, packed = decode(coded.dictionary)
            which = coded.indices.to_numpy()
            root, refuted = {}, set()
            for a, b in zip(cuts[t:u], cuts[t + 1 : u + 1], strict=True):
                whole = key[a, 1] == key[a, 2]
                if b - a > 1 and (whole or side[a] != side[b - 1]):
                    own = which[a - first : b - first]
                    numbers = own.tolist()
                    out += similar(ids[a:b], side[a:b], whole, [sets[x] for x in numbers], lambda own=own, packed=packed: packed(own), percent, k, margin, small, parts[a:b], (root, refuted, numbers))
            t = u
        return out

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            last = [batch.column(c)[-1].as_py() for c in _TILE]
            of_last = np.logical_and.reduce([batch.column(c).to_numpy() == x for c, x in zip(_TILE, last, strict=True)])
            at = int(np.argmax(of_last))
            if at or (held and [held[-1].column(c)[-1].as_py() for c in _TILE] != last):
                done = pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
                held = []
                yield _edges([p for part in done.to_batches() for p in found(part)])
            held.append(batch.slice(at) if at else batch)
        if held:
            done = pa.Table.from_batches(held).combine_chunks()
            yield _edges([p for part in done.to_batches() for p in found(part)])

    return ordered.mapInArrow(run, "src long, dst long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["src", "dst"])


def _weight() -> Column:
    """The share of a block that an item takes, at least one place of it."""
    return F.greatest(F.lit(1.0 / BLOCK), F.least(F.col("n") / BLOCK_MEMBERS, F.lit(1.0)))


def _against_leaders(pairs: DataFrame, items: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The tiles in which each item of pairs (id, leader, part) meets its leader: a leader's items in chunks, and the leader
    in each of them. Also the tables that they read."""
    weighed = stored(pairs.join(items.select("id", "n"), "id").withColumn("w", _weight()).drop("n"), f"{name}-pairs")
    chunks = stored(weighed.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.sum("w")).alias("chunks")), f"{name}-chunks")
    members = lookup(weighed, chunks, "leader", weighed.count(), "members")
    # each item is a part of its own: items of one part count as connected, and the leader's items aren't yet
    one = F.lit(1).cast("long")
    asked = members.select(F.col("leader").alias("group"), (F.pmod(F.xxhash64("id"), F.col("chunks")) + 1).alias("j"), one.cast("int").alias("side"), "id", F.col("id").alias("part"))
    heads = chunks.select(F.col("leader").alias("group"), F.explode(F.sequence(one, F.col("chunks"))).alias("j"), F.lit(0).alias("side"), F.col("leader").alias("id"), F.col("leader").alias("part"))
    both = asked.unionByName(heads).withColumn("i", F.lit(0).cast("long")).withColumn("home", F.col("group"))
    return both.join(items.select("id", "payload"), "id"), [weighed, chunks]


def distinct_items(items: DataFrame, name: str) -> DataFrame:
    """items (id, n, payload), a table, without repeated rows."""
    n = items.count()
    if n == items.select("id").distinct().count():
        return items
    once = stored(items.dropDuplicates(["id", "payload"]), f"{name}-once")
    discard(items)
    return once


def _open(rows: DataFrame, r: int, name: str) -> DataFrame:
    """rows (key, id, part) of the buckets that are of several components, with the bucket's number of items in `members`, a
    leader, and the leader's component in `of`. Of buckets with the same items one is enough. Round 0 takes the smallest
    item as the leader, a later one an item by hash."""
    # aggregates of fixed width only, so that nothing is sorted for them; different ids have different hashes, as xxhash64 of a long is one to one
    order = F.xxhash64("id", F.lit(r)) if r else F.col("id")
    h = F.xxhash64("id")
    sums = F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low_sum"), F.sum(F.shiftright(h, 32)).alias("high_sum")
    each = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("id", order).alias("leader"), F.min_by("part", order).alias("of"), F.count(F.lit(1)).alias("members"), *sums)
    kept = each.where("low <> high").groupBy("low_sum", "high_sum", "members", "leader", "of").agg(F.min("key").alias("key"))
    kept = stored(kept.select("key", "members", "leader", "of"), f"{name}-open")
    out = stored(lookup(rows, kept, "key", rows.count(), "members").select("key", "id", "part", "members", "leader", "of"), f"{name}-buckets")
    discard(kept)
    return out


def components(buckets: DataFrame, items: DataFrame, decode: Decode, percent: int, k: int, name: str, margin: float = MARGIN, small: int = 0, leaders: int = 1) -> DataFrame:
    """(id, component) of the items that are linked with another one.

    buckets: (key, id), a table, of keys that several items have; items: (id, n, payload), a table, with n the size of the
    item's set. leaders: those that an item is verified against in round 0, besides those of its buckets of two.
    """
    active = _open(buckets.select("key", "id", F.col("id").alias("part")), 0, name)
    found: list[DataFrame] = []
    parts = active.select("id", F.col("id").alias("component")).where("false")
    for r in range(ROUNDS):
        # buckets of two items are settled in round 0, those of one block by a tile
        pair = F.col("members") == 2
        mine = active.where("part <> of") if not r else active.where((F.col("part") != F.col("of")) & (F.col("members") > BLOCK))
        asked = mine.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(F.xxhash64("leader").alias("h"), "leader", pair.alias("pair")))).alias("all"))  # one for each band at most
        most = LEADERS if r else leaders
        asked = asked.select("id", F.explode(F.array_distinct(F.transform(F.filter("all", lambda x, i: x["pair"] | (i < most)), lambda x: x["leader"]))).alias("leader"))
        tiles, read = _against_leaders(asked, items, name)
        found.append(stored(links(tiles, decode, percent, k, margin, small), f"{name}-links"))
        if r and found[-1].isEmpty():  # the buckets stay as they are
            discard(*read)
            break
        parts = stored(connected_components(reduce(DataFrame.unionByName, found), f"{name}-parts"), f"{name}-known")
        labelled = stored(active.where("members > 2").select("key", "id").join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part")), f"{name}-labelled")
        discard(active, *read)
        active = _open(labelled, r + 1, name)
        discard(labelled)
        if active.where(F.col("members") > BLOCK).isEmpty():
            break
    if active.isEmpty():
        return parts
    found.append(stored(links(_tiles(active, items, name), decode, percent, k, margin, small), f"{name}-links"))
    return connected_components(reduce(DataFrame.unionByName, found), name)


def _tiles(active: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """The tiles of all pairs of different components in the buckets active (key, id, part, members, leader)."""
    home = F.when(F.col("members") <= HOME, F.col("leader")).otherwise(F.col("key")).alias("home")
    rows = stored(active.select("key", "id", "part", home).join(items.select("id", "n"), "id").withColumn("w", _weight()).drop("n"), f"{name}-rest")
    total = rows.count()
    per = rows.groupBy("key", "part").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    # a component that fills a block has its own ones, numbered after those of the others together
    own = F.struct(F.col("part"), F.when(F.col("w") > 1, F.ceil("w")).otherwise(0).alias("blocks"), "w", "n")
    per = stored(per.withColumn("own", own), f"{name}-rest-parts")
    shape = per.groupBy("key").agg(
        F.sum("n").alias("members"), F.ceil(F.sum(F.when(F.col("own.blocks") == 0, F.col("w")).otherwise(0.0))).alias("mixed"),
        F.array_sort(F.collect_list(F.when(F.col("own.blocks") > 0, F.struct("part", "own.blocks")))).alias("large"),
    )
    start = F.aggregate("large", F.col("mixed"), lambda a, x: a + x["blocks"])
    shape = stored(shape.withColumn("blocks", start), f"{name}-rest-shape")
    at = lookup(rows, shape, "key", total, "members")
    before = F.aggregate(F.filter("large", lambda x: x["part"] < F.col("part")), F.col("mixed"), lambda a, x: a + x["blocks"])
    at = at.withColumn("mine", F.coalesce(F.try_element_at(F.transform(F.filter("large", lambda x: x["part"] == F.col("part")), lambda x: x["blocks"]), F.lit(1)), F.lit(0).cast("long")))
    at = at.withColumn("low", F.when(F.col("mine") > 0, before).otherwise(F.lit(0).cast("long")))
    spread = F.pmod(F.xxhash64("id"), F.when(F.col("mine") > 0, F.col("mine")).otherwise(F.greatest("mixed", F.lit(1))))
    at = at.withColumn("block", F.col("low") + spread)
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: (F.col("mine") == 0) | (j < F.col("low")) | (j >= F.col("low") + F.col("mine")))
    tiled = at.select("key", "id", "part", "home", "block", F.explode(others).alias("other"))
    tiled = tiled.select(
        F.col("key").alias("group"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "id", "part", "home",
    )
    return tiled.join(items.select("id", "payload"), "id")
