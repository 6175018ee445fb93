"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct five-word shingles (words: runs of anything but space, tab, LF, VT, FF and
CR; ASCII lower-cased); a document of one to four words has its whole word sequence as its only shingle.
BANDS * ROWS minima are taken of the set; bands of minima find candidates, and the minima's low two bits,
packed, estimate the similarity before the full sets decide (`simjoin`). Documents with a Jaccard similarity of
at least `percent` / 100 are linked, and a component of links is a group.

At the threshold a pair shares one of the 40 bands of 6 minima with probability 0.9996.

Null and empty texts and texts without words have no set, link with nothing and stay. Equal texts are one class
and never compared. Rows that share a doc_id are one node: what any of their texts links with. A null doc_id has no
component and stays. No rows: no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm import simjoin
from docmd.llm.common import connected_components, discard, lookup, stored
from docmd.llm.textvec import LOWER, NOT_SPACE, grams, slices, tidy, word_hashes, word_spans

SHINGLE = 5
BANDS, ROWS = 40, 6
PERCENT = 75
_RNG = np.random.default_rng(9001)
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for slices of the texts."""
    for first, _, raw, offsets in slices(texts, 1 << 20):
        raw = LOWER[raw]
        starts, ends, words = word_spans(raw, offsets, NOT_SPACE)
        h = word_hashes(raw, starts, ends)
        five = grams(h, SHINGLE, SHINGLE)
        out = []
        for a, b in zip(words[:-1], words[1:], strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(five[a : b - SHINGLE + 1]))
            else:
                out.append(grams(h[a:b], int(b - a), int(b - a)) if b > a else h[:0])
        yield first, out


def minima(members: np.ndarray) -> np.ndarray:
    """The smallest value of each of the BANDS * ROWS functions over the set."""
    x = (members >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        low = np.minimum(low, (x[k : k + 512, None] * _A + _B).min(0))
    return low


def signatures(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(id, n, digest, bands) of every row; n is the size of the set, digest and bands are null for an empty one."""
    slim = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column("t")):
                low = np.stack([minima(s) for s in sets])
                keys = simjoin.band_keys(low, ROWS)
                some = np.array([len(s) > 0 for s in sets])
                bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel()), mask=pa.array(~some))
                digests = pa.array([simjoin.set_digest(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), digests, bands], ["id", "n", "digest", "bands"])

    return slim.mapInArrow(run, "id long, n long, digest binary, bands array<long>")


def payloads(rows: DataFrame) -> DataFrame:
    """(id, n, payload) of rows (id, t): the packed signature and the set, in one binary."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column("t")):
                packed = simjoin.pack(np.stack([minima(s) for s in sets]))
                blobs = pa.array([bits.tobytes() + s.tobytes() for bits, s in zip(packed, sets, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), blobs], ["id", "n", "payload"])

    return rows.mapInArrow(run, "id long, n long, payload binary")


def _decode(blobs: pa.Array) -> tuple[list[np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    words = -(-BANDS * ROWS // 32)
    both = [np.frombuffer(x.as_buffer(), np.uint64) for x in blobs]
    return [x[words:] for x in both], lambda at: np.stack([both[x][:words] for x in at])


def near_duplicates(rows: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(id, n, component) of every row: the smallest id of its group, itself included."""
    signed = stored(signatures(rows, text, key), "neardup-signatures")
    some = signed.where("digest is not null and id is not null")
    total = some.count()
    own = stored(simjoin.classes(some), "neardup-classes")
    # the band keys of each class, from the rows of its representative (equal rows give equal keys)
    reps = some.select("digest", F.col("id").alias("rep"), "bands").join(own, ["digest", "rep"], "left_semi")
    keyed = stored(reps.select(F.col("rep").alias("id"), F.explode("bands").alias("key")), "neardup-keys")
    groups = stored(keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high"), "neardup-groups")
    buckets = stored(lookup(keyed, groups, "key", keyed.count(), "n").select("key", "id").distinct(), "neardup-buckets")
    discard(keyed, groups)
    texts = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null")
    # a shuffle at every size: what buckets hold grows with the corpus
    items = payloads(texts.join(buckets.select("id").distinct().hint("merge"), "id"))
    items = simjoin.distinct_items(stored(items.where("n > 0"), "neardup-items"), "neardup")
    groups = stored(simjoin.components(buckets, items, _decode, percent, BANDS * ROWS, "neardup"), "neardup-components")
    discard(items, buckets)
    # an id of several texts connects their classes
    shared = stored(some.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id"), "neardup-shared")
    if not shared.isEmpty():
        tied = some.select("id", "digest").join(shared, "id", "left_semi").join(own, "digest").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
        groups = connected_components(groups.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(tied), "neardup-tied")
    labelled = own.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"), "class_size")
    joined = lookup(some.select("id", "n", "digest"), stored(labelled, "neardup-labels"), "digest", total, "class_size").select("id", "n", "component")
    rest = signed.where("digest is null or id is null").select("id", "n")
    others = stored(rest.where("id is not null").select("id").distinct(), "neardup-rest")
    if others.isEmpty():
        return joined.unionByName(rest.withColumn("component", F.col("id")))
    # a text without a set, of an id that has another one
    other = joined.join(others, "id", "left_semi").groupBy("id").agg(F.min("component").alias("component"))
    return joined.unionByName(rest.join(other, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(documents).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs that share a shingle, compared on their whole sets, and the smallest id that links reach.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), {SHINGLE}) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {PERCENT} * (na.n + nb.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
