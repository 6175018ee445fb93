"""The dataset manifest, URL filters and centroid clustering, against plain definitions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docmd.llm import centroids, merkle, urlfilter
from tests.llm.conftest import TABLE


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows):
    """The rows of op11, by walking every leaf up a tree of lists."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha(*map(field, (r[0], r[3], r[2], r[4], text)))
    lower = {i: i + 32 for i in range(65, 91)}
    groups = {}
    for r in rows:
        changes = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].translate(lower)) if changes else leaf(r, r[1])))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, at, node):
        proof = []
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            proof += run[: at % 8] + run[at % 8 + 1 :]
            node, at = sha(*run[: at % 8], node, *run[at % 8 + 1 :]), at // 8
        return proof, node

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for at, (known, key, own, now) in enumerate(sorted(groups[g])):
            low, node = climb(trees[g], at, now)
            high, node = climb(top, place, node)
            out.append((key if known else None, own, trees[g][-1][0], top[-1][0], sha(*low, *high), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("count", [1, 9, 65, 520])
def test_manifest_of_any_size(spark, tmp_path, count):
    r = random.Random(count)
    rows = [(i - 3, f"Text {i} Ü" if i % 5 else [None, ""][i % 2], r.choice(["en", "en", "en", "de", None, ""]), r.choice(["s", None]), i if i % 3 else None) for i in range(count)]
    spark.createDataFrame(rows, TABLE).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op11_merkle(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == manifest(rows)
    assert count < 60 or {x[-1] for x in got} == {True, False}


def test_manifest_of_ties_nulls_and_many_groups(spark, tmp_path):
    rows = [(7, "Same", "en", "s", 1)] * 40 + [(7, f"Other {i}", "en", "s", 1) for i in range(5)] + [(None, "No Id", "en", "s", 1)] * 3 + [(i, "X" * 50_000, f"g{i}", None, None) for i in range(80)]
    spark.createDataFrame(rows, TABLE).withColumns({"hash": F.lit("clash"), "at": F.lit(1), "_n": F.lit(2), "Grp": F.lit("x")}).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, merkle.op11_merkle(spark, str(tmp_path)).collect()), key=repr) == manifest(rows)


def test_manifest_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], TABLE).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op11_merkle(spark, str(tmp_path)).collect() == []


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for h, p, v in rules:
        if h and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p):
            best = max(best or (-1,), (len(h) + len(p), len(h), v, h.lower() + p))
    return host, path, best[3] if best else None, best[2] if best else default


URLS = [None, "", "no scheme", "http://", "http:///x", "HTTP://Example.COM/en/a", "http://xexample.com/en/", "http://www.example.com/en/?q#f", "http://example.com?x://y.com/", "http://example.com#/en/",
        "x://a.example.com:80/en/", "http://user@example.com/en/", "http://example.com./en/", "http://a..net/es/x", "http://net/es/", "http://net/esx", "http://é.net/fr/ü", "http://a.NET/FR/", "a://b://c.com/d", "http://com/\n/x"]


def test_urls_of_the_query(spark, tmp_path):
    rows = [(i, u, "h") for i, u in enumerate(URLS + URLS[5:8])] + [(None, URLS[5], None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "key", "range", "rule", "salt")})
    table.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    out = urlfilter.op12_url_filter(spark, str(tmp_path))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((i, *judged(u, urlfilter.RULES))) for i, u, _ in rows)


@pytest.mark.parametrize("seed", range(3))
def test_urls_of_nested_rules(spark, seed):
    """One host has a third of all URLs; borders fall inside of nested intervals."""
    r = random.Random(seed)
    label = lambda: r.choice(["a", "b", "a-b", "a!", "c", "é", ""])
    host = lambda n: ".".join(label() for _ in range(r.randint(1, n)))
    path = lambda: "".join(r.choice(["/", "x", "y"]) for _ in range(r.randint(0, 4)))
    rules = [(host(3), path(), r.choice(["allow", "block"])) for _ in range(60)] + [("a", "/", "block"), ("a", "/", "allow"), (None, "/", "block"), ("b", None, "block"), ("", "/", "block"), ("A.B", "/", "block")]
    urls = [f"http://{'b.a' if r.random() < 0.33 else host(5)}/{path()}" for _ in range(700)]
    table = spark.createDataFrame(list(enumerate(urls)), "id long, url string").withColumn("host", F.lit(1)).repartition(6)
    out = urlfilter.judged(table, spark.createDataFrame(rules, "host string, path string, verdict string"), keep=("id",), default="unknown")
    assert {x.id: tuple(x)[1:] for x in out.collect()} == {i: judged(u, rules, "unknown") for i, u in enumerate(urls)}
    ids = {i: j for i, j in urlfilter.borders(table.select(F.lit("k.").alias("key"), F.col("id").alias("salt")), 700, 16)}
    assert len(ids) == 1  # one key, yet many borders
    assert len(urlfilter.borders(table.select(F.lit("k.").alias("key"), F.col("id").alias("salt")), 700, 16)) > 8


def test_urls_without_rules_or_rows(spark):
    table, none = spark.createDataFrame([(1, URLS[5])], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(x) for x in urlfilter.judged(table, none).collect()] == [(1, "example.com", "/en/a", None, "allow")]
    assert urlfilter.judged(table.where("false"), none).collect() == []


def test_urls_that_are_long(spark):
    """Borders are cut keys; a host of many labels and a path of a MB."""
    urls = [f"http://{'a.' * 300}{x}.com/{'p' * 1_000_000}" for x in "xyz"]
    rules = [("x.com", "/p", "block"), ("a.x.com", "/ppp", "allow"), ("com", "/", "block")]
    out = urlfilter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {x.page_id: (x.rule, x.verdict) for x in out.collect()} == {i: judged(u, rules)[2:] for i, u in enumerate(urls)}


def clustered(rows):
    """The rows of op13 by comparing every vector with every centroid."""
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)[:16]
    c = [x for _, x in starts]
    if not c:
        return []
    distance = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for step in range(4):
        near = [min((distance(x, y), k) for k, y in enumerate(c)) for _, x in v]
        if step < 3:
            for k in range(len(c)):
                own = [x for (_, x), (_, n) in zip(v, near, strict=True) if n == k]
                c[k] = [sum(col) // len(own) for col in zip(*own, strict=True)] if own else c[k]
    inertia = [sum(d for d, n in near if n == k) for k in range(len(c))]
    return sorted(((i, k, d, inertia[k], sum(inertia), sha(",".join(map(str, c[k])))) for (i, _), (d, k) in zip(v, near, strict=True)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("count", [0, 1, 5, 300])
def test_clusters(spark, tmp_path, count):
    r = np.random.default_rng(count)
    # few distinct components: many ties
    rows = [(i, [float(x) for x in (r.integers(-2, 3, 64) / 64 if i % 3 else r.normal(i % 5, 0.3, 64)).astype(np.float32)]) for i in range(count)]
    rows += rows[:3] + ([(None, rows[0][1]), (1000, None), (1001, rows[0][1][:63]), (1002, [None, *rows[0][1][1:]]), (1003, [math.nan, *rows[0][1][1:]]), (1004, [-math.inf, *rows[0][1][1:]]), (1005, []), (1006, [-1e4] * 64)] if count > 5 else [])
    table = spark.createDataFrame([(*x, 1) for x in rows], VECTORS).withColumns({c: F.lit("clash") for c in ("id", "v", "cluster")})
    table.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = centroids.op13_sort_means(spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == clustered(rows)


def test_scan_stops_only_where_none_is_nearer():
    """Every vector, from every last assignment, against all distances; most are on a grid, so that ties are many."""
    r = np.random.default_rng(5)
    for scale in (2, 3, 1000):
        c, v = r.integers(-scale, scale, (12, 3)), r.integers(-scale, scale, (400, 3))
        c[3] = c[7]
        full = ((v[:, None] - c[None]) ** 2).sum(2)
        for last in range(12):
            best, distance = centroids.nearest(v, np.full(400, last), c)
            assert (best == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_clusters_of_components_that_are_too_large(spark):
    for x in (1e30, -1e30, centroids.limit(64) / 64 + 1):
        with pytest.raises(PySparkException):
            centroids.clustered(spark.createDataFrame([(1, [x] * 64, 1)], VECTORS))
    edge = float(np.float32(2.0**20))
    found, _ = centroids.clustered(spark.createDataFrame([(1, [edge] * 64, 1), (2, [-edge] * 64, 1)], VECTORS), clusters=1)
    assert [x.distance for x in found.collect()] == [64 * (64 * 2**20) ** 2] * 2
