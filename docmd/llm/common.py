"""Spark helpers shared by the training-data operators: scratch tables, key lookups that survive
hot keys, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. In local mode a folder of this machine where none is set; elsewhere an error,
    as executors would not find what others wrote."""
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not own:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="docmd-checkpoint-")
        sc.setCheckpointDir(own)
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a table that nobody else writes, in the shared folder."""
    return f"{checkpoint_dir(spark)}/docmd/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors. clean: Spark drops
    the shuffle files of the write when it ends, as nothing reads them any more."""
    path = scratch_path(df.sparkSession, name)
    if clean:
        conf = df.sparkSession.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.select("*").write.parquet(path)  # planned anew, with the setting
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that no later step reads, and lets Spark drop the shuffle files that led to them."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps that are done, before the next step writes its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: list[str], name: str) -> str:
    """name, or with underscores after it a name that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot when it holds more than 1/HOT of all rows, so there are fewer than HOT hot keys.
HOT = 1000


def lookup(rows: DataFrame, values: DataFrame, key: str | list[str], total: int, count: str, how: str = "inner") -> DataFrame:
    """rows joined with values on key. values has one row per key and, in `count`, the rows of that key.

    Keys with more than total / HOT rows are fewer than HOT whatever the data, so they are broadcast;
    the others meet in a shuffle in which no key is large. rows must not hold null keys for `inner`. Both are
    read more than once: they should be tables.
    """
    large = F.lit(max(1, total // HOT))
    if values.where(F.col(count) > large).isEmpty():
        return rows.join(values, key, how)
    hot = values.where(F.col(count) > large)
    cold_rows = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return cold_rows.join(values.where(F.col(count) <= large), key, how).unionByName(rows.join(F.broadcast(hot), key))


def told_apart(rows: DataFrame, node: str, tag: str, more: tuple[Column, ...], name: str, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The things that rows name by two hashes, node (an even long) and tag: (node, tag, id, n, ...), with n their rows and
    the aggregates `more`. id is the node where that has one tag only; things that share a node get odd numbers as ids.
    Also the table of those that share one, None where there are none, as nearly always. asked, with distinct nodes: of the
    things that have one row, only those of its nodes."""
    n = F.count(F.lit(1)).alias("n")
    each = rows.groupBy(node).agg(F.min(tag).alias(tag), F.max(tag).alias("other"), n, *more)
    if asked is not None:
        each = each.join(asked.select(node, F.lit(True).alias("_asked")), node, "left").where("n > 1 or _asked").drop("_asked")
    each = stored(each, name, clean=True)
    clashing = each.where(F.col(tag) != F.col("other"))
    alone = each.drop("other").withColumn("id", F.col(node))
    if clashing.isEmpty():
        return alone, None
    total = each.agg(F.sum("n")).first()[0]
    theirs = lookup(rows, clashing.select(node, F.col("n").alias("_n")), node, total, "_n").groupBy(node, tag).agg(n, *more)
    theirs = stored(theirs.withColumn("id", 2 * F.monotonically_increasing_id() + 1), name, clean=True)
    return alone.join(clashing.select(node), node, "left_anti").unionByName(theirs), theirs


def with_ids(rows: DataFrame, shared: DataFrame | None, node: str, tag: str, total: int) -> DataFrame:
    """rows with the id that `told_apart` gives their node and tag; shared: its second table."""
    if shared is None:
        return rows.withColumn("id", F.col(node))
    return lookup(rows, shared.select(node, tag, "id", "n"), [node, tag], total, "n", "left").withColumn("id", F.coalesce("id", node)).drop("n")


#: Links that a task contracts at once.
CONTRACT = 1 << 18


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links u - v as stars: each id that has a smaller one in reach, and the smallest one it reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    leaf = root != np.arange(len(ids))
    return ids[leaf], ids[root[leaf]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task (u, v), CONTRACT at a time, as stars."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        u, v = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if size + len(batch) > CONTRACT and size:
            yield stars()
            held, size = [], 0
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        size += len(batch)
    if size:
        yield stars()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in edges (src, dst): component is the smallest id that is reachable.

    Every task contracts the links it has by union-find. While more than CONTRACT links are left, alternating
    large-star and small-star contraction follows: every round is a partial aggregate (the smallest neighbour of
    each id) and a lookup join, so a hub's neighbours are never gathered, and tasks contract what they have in
    between. The last CONTRACT links at most, a bound of a few MB, are one task's. Each round is a written table,
    and the one before it is deleted. No edges: no rows.
    """
    kind = "u long, v long"

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    def large_star(e: DataFrame, total: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = minima(both).withColumn("m", F.least("m", "u"))
        joined = lookup(both, small, "u", 2 * total, "n")
        return joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(e: DataFrame, total: int) -> DataFrame:
        low = minima(e)
        joined = lookup(e, low, "u", total, "n")
        return (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )

    ends = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    now = stored(ends.mapInArrow(_stars, kind), name)
    shape = None
    # the rows, and the sum of their targets, which falls until every id points at the root of its star
    measure = (F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)")))
    after = now.agg(*measure).first()
    while after[0] > CONTRACT and after != shape:
        shape = after
        large = stored(large_star(now, after[0]), name)
        last, now = now, stored(small_star(large, after[0]).mapInArrow(_stars, kind).distinct(), name)
        discard(large, last)
        after = now.agg(*measure).first()
    if after[0] <= CONTRACT:
        now = stored(now.coalesce(1).mapInArrow(_stars, kind), name)
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
