"""URL filters by a sort-merge range join.

A host's key is its labels in reversed order, each with a dot after it: the keys of a host and all its subdomains are the
ones that begin with its key, an interval of the sorted keys. URLs and rules meet in ranges of (key, salt). The salt, a hash
of the URL's own row, parts a host of any share of the rows into several ranges. A rule goes to every range that its interval
touches. In a range, rows are swept in the order of their keys; a stack holds the rules whose interval is open there, nested
as intervals of prefixes are, with those of one host at one level. A rule fits if the URL's path begins with the rule's; the
one with the longest host and path together wins, of equally long ones that with the longest host.

The ranges' borders come from a sample of keys, SAMPLE to a range, which is all that the driver holds. They say where work is
parted, not what is found. A level of the stack finds the longest path by one lookup for each length that its rules have.

Defined results: a null URL, or one without `://`, has an empty host and path; an empty host fits no rule, and the verdict
is `default`. Rules with a null or empty host, or a null path, fit nothing. Of rules with equal host and path, `block` wins.
Equal rows are judged each. No rules: every URL gets `default`. No rows: no result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import shuffle_partitions, stored
from docmd.llm.textvec import tidy

#: Ranges for each shuffle partition, so that partitions hold about as much of each other.
RANGES = 4
#: Sampled keys for each range, and the characters of a key that a border has at most.
SAMPLE, BORDER = 20, 256
ALLOW, BLOCK = "allow", "block"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def host_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case, from the first `://` to `/`, `?`, `#` or the end; the path from there to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lowered(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels reversed, each with a dot after it; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def borders(keys: DataFrame, total: int, ranges: int) -> list[tuple[bytes, int]]:
    """At most ranges - 1 sorted borders of rows (key, salt) that part them about evenly."""
    wanted = SAMPLE * ranges
    some = keys if total <= wanted else keys.sample(min(1.0, 1.2 * wanted / total), 12)
    found = sorted((bytes(r.key), r.salt) for r in some.select(F.substring("key", 1, BORDER).cast("binary").alias("key"), "salt").limit(2 * wanted).collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def _with_ranges(rows: DataFrame, at: list[tuple[bytes, int]]) -> DataFrame:
    """rows (key, salt, ...) with `range`: the borders at or before (key, salt)."""
    schema = rows.withColumn("range", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(batch.column("key").cast(pa.binary()).to_pylist(), batch.column("salt").to_pylist(), strict=True)
            own = pa.array([bisect.bisect_right(at, p) for p in places], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "range"])

    return rows.mapInArrow(run, schema)


def _rule_ranges(rules: DataFrame, at: list[tuple[bytes, int]]) -> DataFrame:
    """(range, key, path, verdict, rule): every rule in each range that its interval touches."""
    least = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, key in enumerate(batch.column("key").cast(pa.binary()).to_pylist()):
                # keys end with a dot; the interval ends where a slash, the next byte, stands in its place
                low, high = bisect.bisect_right(at, (key, least)), bisect.bisect_left(at, (key[:-1] + b"/", least))
                for first in range(low, high + 1, 1000):
                    n = min(1000, high + 1 - first)
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int32()), *(pa.repeat(batch.column(c)[k], n) for c in ("key", "path", "verdict", "rule"))], ["range", "key", "path", "verdict", "rule"])

    return rules.select("key", "path", "verdict", "rule").mapInArrow(run, "range int, key string, path string, verdict string, rule string")


class Sweep:
    """The open rules at a place of the sorted keys."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []  # key, rule and verdict by path, the paths' lengths

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, found, sizes = self.stack[-1]
        found[path] = (rule, verdict)
        where = bisect.bisect_left(sizes, len(path))
        if where == len(sizes) or sizes[where] != len(path):
            sizes.insert(where, len(path))

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        """The rule and verdict of the longest rule that fits."""
        self.close(key)
        best, most = None, -1
        for own, found, sizes in reversed(self.stack):
            for n in reversed(sizes):
                # a key is one longer than its host
                if len(own) + n <= most:
                    break
                if n <= len(path) and path[:n] in found:
                    best, most = found[path[:n]], len(own) + n
                    break
        return best


def judged(rows: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = ALLOW) -> DataFrame:
    """The kept columns with host, path, rule and verdict. rules: (host, path, verdict). Kept columns named host, path, rule or
    verdict are replaced."""
    kept = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    own = [f"_k{i}" for i in range(len(kept))]
    host, path = host_path(F.col(url))
    slim = rows.select(*(F.col(c).alias(o) for c, o in zip(kept, own, strict=True)), host.alias("host"), path.alias("path"))
    slim = stored(slim.withColumns({"key": host_key(F.col("host")), "salt": F.xxhash64(F.monotonically_increasing_id())}), "urls")
    own_host = lowered(F.col("host"))
    own_rules = (
        rules.where("host <> '' and path is not null").select(own_host.alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(host_key(F.col("host")).alias("key"), "path", "verdict", F.concat("host", "path").alias("rule"))
    )
    named = slim.where("key <> ''")
    ranges = RANGES * shuffle_partitions(rows.sparkSession)
    at = borders(named.select("key", "salt"), named.count(), ranges)
    kinds = [slim.schema[o].dataType for o in own]
    urls = _with_ranges(named, at).select("range", "key", F.lit(1).alias("kind"), "salt", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "host", "path", *own)
    opened = _rule_ranges(own_rules, at).select("range", "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), "rule", "verdict", F.lit(None).cast("string").alias("host"), "path", *(F.lit(None).cast(k).alias(o) for k, o in zip(kinds, own, strict=True)))
    both = urls.unionByName(opened).repartition("range").sortWithinPartitions("range", "key", "kind")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, now = Sweep(), None
        for batch in batches:
            found, at_rows = [], []
            columns = (batch.column(c).to_pylist() for c in ("range", "key", "kind", "path", "rule", "verdict"))
            for i, (part, key, kind, path_, rule, verdict) in enumerate(zip(*columns, strict=True)):
                if part != now:
                    sweep, now = Sweep(), part
                if kind:
                    found.append(sweep.judge(key, path_) or (None, default))
                    at_rows.append(i)
                else:
                    sweep.open(key, path_, rule, verdict)
            some = batch.take(pa.array(at_rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in (*own, "host", "path")), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [*own, "host", "path", "rule", "verdict"])

    none = slim.where("key = ''").select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    out = both.mapInArrow(run, none.schema).unionByName(none)
    return out.select(*(F.col(o).alias(c) for c, o in zip(kept, own, strict=True)), "host", "path", "rule", "verdict")


#: The rules of the query.
RULES = (("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


def _oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH r(h, p, v) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS id, page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
w AS (SELECT id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM w JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY id)
SELECT page_id, host, path, rule, coalesce(v, '{ALLOW}') AS verdict FROM w LEFT JOIN m USING (id)
"""


ORACLE_SQL = _oracle()
