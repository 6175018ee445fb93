"""Fuzzy duplicate lines by MinHash, one line of each group kept.

Lines are the parts of a text between line feeds, compared ASCII lower-cased and without white space at their
ends. A line's set holds its distinct runs of SHINGLE characters (a shorter line is its own only member). Minima
of the set, by one hash in bins with the empty bins filled from the next, make BANDS bands of ROWS; lines that
share a band are candidates, which a Jaccard similarity of at least PERCENT / 100 on the full sets confirms
(`simjoin`; sets of at most SMALL members without an estimate before). A pair at the threshold shares a
band with probability 1 - (1 - 0.8^5)^20 = 0.9996 if its minima were independent; as bins are filled from others they
aren't quite, so the tests measure it. Components of confirmed links are the groups. Of a group the
line with the smallest (doc_id, line number) stays, in documents as they are.

A line is known by 127 bits of a hash of its characters: a node of 63, and a tag of 64. Equal lines are one, so copies
are never compared. Lines that share a node but not the tag get ids of their own, and none of them goes for another;
only a link between two such lines, when they are similar too, can be missed. One pass over the texts hashes and signs the
lines. Every task groups the lines of its own by band key and sends each key once, so a key that a third of all lines have
reaches its range at most once a task. Of the lines that share a key with another one the bytes go on, not the sets.

Blank lines always stay. Null and empty texts stay as they are, and so do rows without a doc_id. Rows that share
a doc_id are the same document: the line that stays does so in all of them, and a line number with another line in it
is that line. Texts of any length are handled whole. No rows: no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm import simjoin
from docmd.llm.common import discard, lookup, told_apart, unused, with_ids
from docmd.llm.common import stored as _stored
from docmd.llm.textvec import LOWER, Spans, slices, tidy

SHINGLE, PERCENT = 8, 80
BANDS, ROWS, GROUPS = 20, 5, 2
K = BANDS * ROWS
MARGIN = 0.3
#: Few members make estimates too rough for the margin.
SMALL = 64
#: Keys that a task holds before it sends them.
FLUSH = 1 << 20
#: Bits of a node. Fewer only make more lines share one.
NODE_BITS = 63
_LINE = pa.struct([("node", pa.int64()), ("tag", pa.int64())])
stored = functools.partial(_stored, clean=True)
_EMPTY = np.uint32(0xFFFFFFFF)
_BLANK = np.zeros(0x3001, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def _trimmed(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at their ends; an empty one ends where it starts."""
    is_blank = lambda at: _BLANK[np.minimum(points[at], 0x3000)] & (points[at] <= 0x3000)
    starts, ends = starts.copy(), ends.copy()
    for edge, step in ((starts, 1), (ends, -1)):
        at = np.flatnonzero(starts < ends)
        for _ in range(64):  # a place at a time, for the few spans that have blanks there
            at = at[is_blank(edge[at] - (step < 0))] if len(at) else at
            if not len(at):
                break
            edge[at] += step
            at = at[starts[at] < ends[at]]
        for i in at:  # long runs of blanks
            inside = np.flatnonzero(~is_blank(np.arange(starts[i], ends[i])))
            starts[i], ends[i] = (starts[i] + inside[0], starts[i] + inside[-1] + 1) if len(inside) else (starts[i], starts[i])
    return starts, ends


def lines(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: first and end row, code points, and per line its row (from first), trimmed start and end."""
    for first, end, raw, offsets in slices(texts, 1 << 18):
        raw = LOWER[raw]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) == len(raw):
            at = offsets
        else:
            per_row = [len(raw[a:b].tobytes().decode("utf-8", "surrogateescape")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            at = np.concatenate([[0], np.cumsum(per_row)])
        breaks = np.flatnonzero(points == 10)
        starts = np.sort(np.concatenate([at[:-1], breaks + 1]))
        row = np.searchsorted(at, np.concatenate([at[:-1], breaks]), "right") - 1
        # a text that begins where an empty one does: its own row, in order
        row[: len(at) - 1] = np.arange(len(at) - 1)
        order = np.lexsort((np.concatenate([at[:-1], breaks + 1]), row))
        starts, row = np.concatenate([at[:-1], breaks + 1])[order], row[order]
        ends = np.append(starts[1:], len(points))
        last = np.append(row[1:] != row[:-1], True)
        ends = np.where(last, at[row + 1], ends - 1)
        starts, ends = _trimmed(points, starts, ends)
        yield first, end, points, row, starts, ends


def _members(spans: Spans, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the lines, one after another, and the number of each line's; lines in order of their starts."""
    sizes = np.where(ends > starts, np.maximum(ends - starts - SHINGLE + 1, 1), 0)
    every = spans.runs
    # where a line's shingles begin: 1 from its start, and back to 0 after its last one
    inside = np.zeros(len(every) + 2, np.int8)
    long = ends - starts >= SHINGLE
    inside[starts[long]] += 1
    inside[ends[long] - SHINGLE + 1] -= 1
    keep = np.cumsum(inside[: len(every)], dtype=np.int8).view(bool)
    if not (short := np.flatnonzero(~long & (ends > starts))).size:
        return every[keep], sizes
    cut = np.cumsum(sizes)
    out = np.empty(cut[-1] if len(cut) else 0, np.uint64)
    place = np.ones(len(out), bool)
    place[cut[short] - 1] = False
    out[place] = every[keep]
    out[cut[short] - 1] = spans.hashes(starts[short], ends[short])
    return out, sizes


def _nodes(lines_: Iterable, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, even numbers, and tags of some lines, given as their code points' bytes."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines_)), np.int64).reshape(-1, 2)
    return both[:, 0] & np.int64(((1 << bits) - 1) << 1 if bits < NODE_BITS else -2), both[:, 1]


def _found(lists: pa.Array, texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, pa.Array, list[str]]:
    """Of lists of (line, node, tag, ...), one for each text: those where the text has that line. Their rows, line numbers, items
    and the lines as they are compared. Only the lines asked for are looked at."""
    flat = lists.flatten()
    cut = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    line, wanted, mark = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("line", "node", "tag"))
    numbers = line.tolist()
    there, own = [], []
    for i in np.flatnonzero(np.diff(cut)).tolist():
        parts = _parts(texts[i])
        for k in range(cut[i], cut[i + 1]):
            if numbers[k] < len(parts):
                there.append(k)
                own.append(parts[numbers[k]].lower().decode("utf-8", "surrogateescape").strip())  # what _BLANK and LOWER do
    at = np.array(there, np.int64)
    node, tag = _nodes((x.encode("utf-32-le", "surrogatepass") for x in own), bits)
    same = (node == wanted[at]) & (tag == mark[at])
    at = at[same]
    return np.searchsorted(cut, at, "right") - 1, line[at], flat.take(pa.array(at)), [own[k] for k in np.flatnonzero(same).tolist()]


def _parts(text: pa.Scalar) -> list[bytes]:
    """The lines of a text, as they are."""
    return text.as_buffer().to_pybytes().split(b"\n") if text.is_valid else []


def minima(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """K minima of each set: GROUPS (2) functions, the halves of the hash, each with K / GROUPS bins."""
    bins = K // GROUPS
    out = np.full((len(sizes), K), _EMPTY, np.uint32)
    flat = out.ravel()
    base = np.repeat(np.arange(len(sizes), dtype=np.int64) * K, sizes)
    halves = np.ascontiguousarray(members).astype("<u8", copy=False).view("<u4")
    for g in range(GROUPS):
        # of the product with the number of bins, the upper half is the bin and the lower one the value
        product = np.multiply(halves[g::2], np.uint64(bins), dtype=np.uint64).view("<u4")
        np.minimum.at(flat[g * bins :], product[1::2] + base, product[::2] >> np.uint32(1))
    grid = out.reshape(-1, bins)
    known = grid != _EMPTY
    n = np.count_nonzero(known, axis=1)
    rows = np.flatnonzero((n > 0) & (n < bins))
    if len(rows):
        # a filled bin is taken for the empty ones before it, and a row's first one for those after its last
        filled = np.flatnonzero(known[rows])
        after = np.cumsum(n[rows])
        first = filled[after - n[rows]]
        value = grid[rows].ravel()
        times = np.diff(np.insert(filled + 1, after, (np.arange(len(rows)) + 1) * bins), prepend=0)
        found = np.repeat(np.insert(value[filled], after, value[first]), times)
        # how far it is makes the value another one
        far = (np.repeat(np.insert(filled, after, first + bins), times) - np.arange(len(value))).astype(np.uint32)
        far *= np.uint32(0x9E3779B1)
        grid[rows] = ((found ^ far) & np.uint32(0x7FFFFFFF)).reshape(-1, bins)
    return out


def signed(rows: DataFrame, key: str, text: str, bits: int = NODE_BITS) -> DataFrame:
    """(doc, nodes, key, node) from one pass: rows (doc, nodes) with the node and tag of every line of a text, null for blank
    ones; and rows (key, node) with the nodes of every band key that several have, some more than once.

    Tasks send the band keys of their lines as sorted arrays by range, part -1 being those that several of their lines share.
    """
    slim = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"))
    parts = 4 * max(4, slim.rdd.getNumPartitions())
    kind = slim.schema["doc"].dataType
    schema = f"doc {kind.simpleString()}, nodes array<struct<node:long,tag:long>>, part int, keys binary, owners binary"

    def send(keys: np.ndarray, owners: np.ndarray, types: list[pa.DataType]) -> pa.RecordBatch:
        k, o, first, alone = _buckets(keys, owners)
        here = ~alone
        at = np.append(np.searchsorted(k[first], [((i << 64) // parts) - (1 << 63) for i in range(parts)]), int(first.sum()))
        ks, os_ = k[first], o[first]
        some = [i for i in range(parts) if at[i + 1] > at[i]]
        blobs = [[*(x[at[i] : at[i + 1]].tobytes() for i in some), y[here].tobytes()] for x, y in ((ks, k), (os_, o))]
        n = len(some) + 1
        return pa.RecordBatch.from_arrays([pa.nulls(n, types[0]), pa.nulls(n, types[1]), pa.array([*some, -1], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], _NAMES)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, types = 0, [pa.null(), pa.list_(_LINE)]
        for batch in batches:
            types[0] = batch.schema.field("doc").type
            for first, end, points, row, starts, ends in lines(batch.column("t")):
                some = ends > starts
                spans = Spans(points, SHINGLE)
                view = memoryview(points)
                node, tag = _nodes((view[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), bits)
                nodes = pa.StructArray.from_arrays([pa.array(node), pa.array(tag)], fields=list(_LINE), mask=pa.array(~some))
                cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=end - first))]), pa.int32())
                n = end - first
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(first, n), pa.ListArray.from_arrays(cut, nodes), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                    _NAMES,
                )
                one = np.sort(np.unique(tag[some], return_index=True)[1])  # lines in the order of the text
                own = node[some][one]
                members, sizes = _members(spans, starts[some][one], ends[some][one])
                held.append((simjoin.band_keys(minima(members, sizes), ROWS).ravel(), np.repeat(own, BANDS)))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield send(*map(np.concatenate, zip(*held, strict=True)), types)
                    held, size = [], 0
        if size:
            yield send(*map(np.concatenate, zip(*held, strict=True)), types)

    out = f"doc {kind.simpleString()}, nodes array<struct<node:long,tag:long>>, key long, node long"

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table.filter(pa.compute.is_valid(table["doc"]))
        sent = table.filter(pa.compute.is_null(table["doc"]))
        keys, owners = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for c in sent[n].chunks for x in c)]) for n in ("keys", "owners"))
        if not len(texts):
            if sent["part"][0].as_py() >= 0:
                keys, owners, _, alone = _buckets(keys, owners)
                keys, owners = keys[~alone], owners[~alone]
        n, m = len(texts), len(keys)
        first = texts.select(["doc", "nodes"]).append_column("key", pa.nulls(n, pa.int64())).append_column("node", pa.nulls(n, pa.int64()))
        second = pa.table([pa.nulls(m, first.schema.field("doc").type), pa.nulls(m, first.schema.field("nodes").type), pa.array(keys), pa.array(owners)], schema=first.schema)
        return pa.concat_tables([first, second])

    # texts, and keys that met in the tasks, come in as many groups as there are tasks
    group = F.when(F.col("part") >= 0, F.col("part")).otherwise(-1 - F.spark_partition_id())
    return slim.mapInArrow(run, schema).withColumn("group", group).groupBy("group").applyInArrow(meet, out)


_NAMES = ["doc", "nodes", "part", "keys", "owners"]


def _buckets(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, owner), sorted; where a key begins; and whether its owner is the only one."""
    order = np.argsort(keys)
    keys, owners = keys[order], owners[order]
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    same[:-1] |= same[1:]
    some = np.flatnonzero(same)  # few: only there does the order of the owners matter
    owners[some] = owners[some[np.lexsort((owners[some], keys[some]))]]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[new], owners[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys, owners, first, first & np.append(first[1:], True)


def payloads(rows: DataFrame, bits: int = NODE_BITS) -> DataFrame:
    """rows (t, wanted: (line, node, tag, id)) as (id, n, payload): the bytes of each wanted line that the text has, n its shingles.

    A doc_id may have several texts: a wanted line is taken from those where it is the wanted node.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, items, own = _found(batch.column("wanted"), batch.column("t"), bits)
            sizes = pa.array([max(len(x) - SHINGLE + 1, 1) for x in own], pa.int64())
            blobs = pa.array([x.encode("utf-8", "surrogatepass") for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([items.field("id"), sizes, blobs], ["id", "n", "payload"])

    return rows.mapInArrow(run, "id long, n long, payload binary")


def _decode(blobs: pa.Array) -> tuple[list[np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """The shingle sets of some lines, and what packs their minima."""
    cut = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4)
    raw = np.frombuffer(blobs.buffers()[2], np.uint8)[cut[0] : cut[-1]] if cut[-1] > cut[0] else np.zeros(0, np.uint8)
    cut = cut.astype(np.int64) - cut[0]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < len(raw):
        cut = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[cut]
    members, sizes = _members(Spans(points, SHINGLE), cut[:-1], cut[1:])
    ends = np.cumsum(sizes)
    sets = []
    for b, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        own = np.sort(members[b - n : b])
        new = np.ones(n, bool)
        np.not_equal(own[1:], own[:-1], out=new[1:])
        sets.append(own[new])
    return sets, lambda at: simjoin.pack(minima(np.concatenate([sets[x] for x in at]), np.array([len(sets[x]) for x in at])))


def repeated_lines(rows: DataFrame, text: str = "text", key: str = "doc_id", bits: int = NODE_BITS) -> DataFrame:
    """(doc, line, node, tag) of every line that goes because another one of its group stays."""
    passed = stored(signed(rows, key, text, bits), "lines")
    known = passed.where("doc is not null").select("doc", F.posexplode("nodes").alias("line", "n")).where("n is not null").select("doc", "line", "n.*")
    shared = stored(passed.where("key is not null").select("key", "node").distinct(), "line-buckets")
    scratch = shared.scratch
    # other lines stay, whatever comes
    each, clashing = told_apart(known, "node", "tag", (F.min(F.struct("doc", "line")).alias("first"),), "line-nodes", shared.select("node").distinct())
    if clashing is not None:  # all lines of a node are in its buckets
        apart = stored(shared.join(clashing.select("node", "id"), "node", "left").select("key", F.coalesce("id", "node").alias("id")), "line-buckets")
        discard(shared)
        shared = apart
    else:
        shared = shared.withColumnRenamed("node", "id")
        shared.scratch = scratch
    ids = shared.select("id").distinct()
    item = F.struct(F.col("first.line").alias("line"), "node", "tag", "id")
    wanted = each.join(ids, "id").groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(item).alias("wanted"))  # no more than a text's lines
    texts = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"))
    items = simjoin.distinct_items(stored(payloads(texts.join(wanted.hint("shuffle_hash"), "doc").select("t", "wanted"), bits), "line-items"), "line")
    groups = simjoin.components(shared, items, _decode, PERCENT, K, "line", MARGIN, SMALL, simjoin.LEADERS)
    groups = stored(groups, "line-groups")
    discard(shared, items)
    # a line that is neither repeated nor in a group stays
    labelled = each.join(groups, "id", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    labelled = stored(labelled, "line-labels")
    keepers = stored(labelled.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("n").alias("lines"), F.count(F.lit(1)).alias("members")).where("lines > 1"), "line-groups")
    total = each.agg(F.sum("n")).first()[0] or 0
    marked = stored(lookup(labelled.select("id", "n", "component"), keepers, "component", labelled.count(), "members").select("id", "keeper", "n"), "line-keepers")
    discard(labelled, keepers, groups)
    named = with_ids(known, clashing, "node", "tag", total)
    return lookup(named, marked.hint("shuffle_hash"), "id", total, "n").where(F.struct("doc", "line") != F.col("keeper")).select("doc", "line", "node", "tag")


def without_repeats(rows: DataFrame, text: str = "text", key: str = "doc_id", bits: int = NODE_BITS) -> DataFrame:
    """rows with the repeated lines taken out of their texts, n_lines and n_removed; these replace columns of their names."""
    names = [c for c in rows.columns if c not in ("n_lines", "n_removed")]
    doc, mark = unused(names, "_doc"), unused(names, "_gone")
    gone = stored(repeated_lines(rows, text, key, bits).groupBy(F.col("doc").alias(doc)).agg(F.collect_set(F.struct("line", "node", "tag")).alias(mark)), "line-gone")
    own = rows.select(*names)
    joined = own.join(gone.hint("shuffle_hash"), F.col(key) == F.col(doc), "left").drop(doc)
    schema = own.withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone_ = batch.column(text), batch.column(mark)
            n_lines = pa.compute.if_else(pa.compute.equal(pa.compute.binary_length(texts), 0), 0, pa.compute.add(pa.compute.count_substring(texts, "\n"), 1))
            n_removed = np.zeros(len(texts), np.int64)
            some = pa.compute.is_valid(gone_)
            before, wanted = texts.filter(some), gone_.filter(some)
            owner, at, _, _ = _found(wanted, before, bits)
            cut = np.searchsorted(owner, np.arange(len(before) + 1)).tolist()
            changed, count = [], []
            for i in range(len(before)):
                parts, drop = _parts(before[i]), set(at[cut[i] : cut[i + 1]].tolist())
                changed.append(b"\n".join(x for k, x in enumerate(parts) if k not in drop) if parts else None)
                count.append(len(drop))
            n_removed[some.to_numpy(zero_copy_only=False)] = count
            out = pa.compute.replace_with_mask(texts, some, pa.array(changed, pa.binary()).view(pa.string()))
            columns = [out if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.compute.fill_null(n_lines, 0).cast(pa.int64()), pa.array(n_removed)], [*names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, lines taken out, and the SHA-256 of the text that stays."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(documents).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))
