"""Centroid clustering by sort-means, in whole numbers.

Vectors are scaled and floored to integers. Every round orders, for each centroid, the others by their distance from it. A
vector scans that order from the centroid that it had before, and stops at the first centroid that is strictly farther from
it than twice the vector's distance: by the triangle inequality neither that one nor any after it can be nearer, nor as
near. Ties go to the smaller number. All distances are squared integers, so the rule is exact: D(c, other) > 4 D(c, x).

A round is one narrow pass over a written table, which holds vectors and their last assignment. Tasks sum their vectors by
cluster (k rows a task), and the sums meet as decimals. Only k centroids, parameters, come to the driver: k times the
dimensions. Nothing is shuffled by cluster, so a cluster of any share of the rows is no matter.

Defined results: vectors that are null, have another number of components or a null or non-finite one, are left out. A null
id never starts a centroid, but its vector is assigned. Rows that share an id are vectors of their own. Fewer vectors than k:
as many centroids. Equal starting vectors give equal centroids; the smaller number gets all, the others stay empty and where
they are. No rows: no result. A scaled component beyond
`limit` (for 64 dimensions 94,906,265) is an error, as four times a squared distance would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import discard, stored
from docmd.llm.textvec import tidy

SCALE, DIMENSIONS, CLUSTERS, ROUNDS = 64, 64, 16, 3
_CHUNK = 8192
_SCHEMA = "id long, v array<int>, cluster int, distance long"


def limit(dimensions: int) -> int:
    """The largest component of which four times a squared distance fits 63 bits."""
    return math.isqrt((1 << 61) // dimensions) // 2


def whole(rows: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that are taken."""
    x = F.col(vector)
    taken = rows.where((F.size(x) == dimensions) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    most = limit(dimensions)
    scaled = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    checked = F.transform(scaled, lambda e: F.when(F.abs(e) <= most, e.cast("int")).otherwise(F.raise_error(F.lit(f"a scaled component is beyond {most}")).cast("int")))
    return taken.select(F.col(key).cast("long").alias("id"), checked.alias("v"))


def nearest(v: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and the squared distance, scanned from `last` by sort-means."""
    gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.argsort(gaps, axis=1, kind="stable")
    best, distance = last.copy(), ((v - centroids[last]) ** 2).sum(1)
    for c in np.unique(last):
        mine = np.flatnonzero(last == c)
        bound = 4 * distance[mine]
        for other in order[c]:
            if other == c:
                continue
            # those that stop here stop for good, as the others only get farther
            near = bound >= gaps[c, other]
            mine, bound = mine[near], bound[near]
            if not len(mine):
                break
            d = ((v[mine] - centroids[other]) ** 2).sum(1)
            better = (d < distance[mine]) | ((d == distance[mine]) & (other < best[mine]))
            best[mine[better]], distance[mine[better]] = other, d[better]
    return best, distance


def _vectors(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dimensions).astype(np.int64)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, v, cluster, distance) of vectors (id, v, cluster)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for i in range(0, len(large), _CHUNK):
                batch = large.slice(i, _CHUNK)
                best, distance = nearest(_vectors(batch, centroids.shape[1]), batch.column("cluster").to_numpy().astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    return vectors.select("id", "v", "cluster").mapInArrow(run, _SCHEMA)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids at their vectors' floored means; empty ones stay."""
    k, size = centroids.shape

    @tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)  # 2^36 rows of a task fit
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            v = _vectors(batch, size)
            for c in np.unique(cluster):
                total[c] += v[cluster == c].sum(0)
            count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.select("v", "cluster").mapInArrow(sums, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("j", "x")).groupBy("cluster", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in each.collect():  # k * dimensions rows
        out[r.cluster, r.j] = int(r.x) // r.n
    return out


def clustered(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance) of every vector that is taken, and the centroids."""
    own = whole(rows, key, vector, dimensions, scale)
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    starts = own.where("id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    centroids = np.array([r.v for r in starts], np.int64).reshape(-1, dimensions)
    if not len(centroids):
        # without an id no centroid starts, and no vector has one
        return rows.sparkSession.createDataFrame([], _SCHEMA), centroids
    now = assigned(own.withColumn("cluster", F.lit(0)), centroids)
    for r in range(rounds):
        before, now = now, stored(now, f"clusters-{r}")
        if r:
            discard(older)
        centroids, older = moved(now, centroids), now
        now = assigned(now, centroids)
    return now, centroids


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = stored(found.drop("v"), "clusters")
    inertia = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # a row for each centroid
    facts = [(c, int(inertia.get(c, 0)), int(sum(inertia.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    each = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    distance = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        f"e AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM (SELECT vec_id, v FROM e WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), v LIMIT {CLUSTERS}))",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} AS (SELECT id, vec_id, v, d.k AS k, d.d AS d FROM (SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': {distance}, 'k': k}}) AS d FROM e, c{r} GROUP BY id))")
        if r < ROUNDS:
            ctes.append(f"s{r} AS (SELECT k, j, floor_div AS x FROM (SELECT k, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY k, j))")
            ctes.append(f"c{r + 1} AS (SELECT k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(CAST(x AS BIGINT) ORDER BY j) AS c FROM s{r} GROUP BY k) m USING (k))")
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)
"""
    )


ORACLE_SQL = _oracle()
