"""Merkle dataset manifest with parent-preimage paths.

Every row is a leaf: the hash of its fields, each `-` for null, else its UTF-8 byte count, `:` and its value. Per group
(a column's value) leaves ascend by key, and FAN nodes in a row become their parent while a group has several nodes; the
last run of a level may be shorter, even one node. The groups' subroots, in the groups' order, give the root alike.

A parent is stored as its preimage: the hashes of its children, one after another, DIGEST characters each. `paths` joins
each leaf with the preimages of its ancestors and its slot in each. A proof excises the slot's characters, which leaves the
siblings; folding splices a replacement into the slot, hashes, and goes on with the parent.

The leaves are sorted once by ranges of (group, key), so that a group of any share of the rows spreads over all tasks; their
places follow from counts per task and group. They are shuffled once more, by parent; every level above has 1/FAN of the
rows of the one below. Preimages come down by joins on (group, parent), a key of at most FAN rows, and leaves are taken out
of their parents' rows only then. All is done by built-in functions.

Defined results: a null group is a group of its own, before all others; null keys come before others; rows with one key
ascend by leaf; equal rows have equal leaves at neighbouring places. Empty texts are `0:`, not `-`. Extra columns of any name
are no part of a leaf. One leaf in all: it is subroot and root, with an empty path. No rows: no result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmd.llm.common import discard, stored

FAN = 8
DIGEST = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """The leaf of fields."""
    texts = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def leaves(rows: DataFrame, group: str, key: str, leaf: Column, now: Column | None = None) -> DataFrame:
    """(grp, key, hash, now) of every row. grp sorts as group does, with null first, and is never null; now is the leaf of
    the row as it is today, to be folded, and is the stored one where none is given."""
    own = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    return rows.select(own.alias("grp"), F.col(key).alias("key"), leaf.alias("hash"), (leaf if now is None else now).alias("now"))


def ranked(nodes: DataFrame, name: str, *order: str) -> DataFrame:
    """nodes with `at`, the place in the group from 0 by `order`, and `n`, the nodes of the group."""
    # equal rows may be any number: the place in the input parts them
    placed = stored(nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("grp", *order, "_tie").sortWithinPartitions("grp", *order, "_tie").drop("_tie")
                    .withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33).alias("_part")
    # a row for each task and group that meet: as many as tasks and groups together
    counts = placed.groupBy("grp", part).agg(F.min("_place").alias("_low"), F.count(F.lit(1)).alias("_n"))
    whole, before = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("grp", "_part", (F.col("_low") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    joined = placed.withColumn("_part", F.shiftright("_place", 33)).join(offsets, ["grp", "_part"])
    return joined.withColumn("at", F.col("_place") - F.col("_shift")).drop("_place", "_part", "_shift")


@dataclass
class Tree:
    """levels[k] has the parents of level k + 1, (grp, at, n, preimage, hash): n nodes has the group there, and a group of
    one leaf has it as it is, with no preimage. levels[0] also has the children's (key, now)."""

    levels: list[DataFrame]

    def subroots(self) -> DataFrame:
        """(grp, hash) of every group."""
        tops = [x.where("n = 1").select("grp", "hash") for x in self.levels]
        out = tops[0]
        for x in tops[1:]:
            out = out.unionByName(x)
        return out


def _parents(nodes: DataFrame, *carried: str) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("at", "hash", *carried)))
    up = nodes.groupBy("grp", F.floor(F.col("at") / FAN).cast("long").alias("up")).agg(F.first("n").alias("below"), children.alias("children"))
    preimage = F.when(F.col("below") > 1, F.array_join("children.hash", ""))
    slim = up.select("grp", F.col("up").alias("at"), F.ceil(F.col("below") / FAN).cast("long").alias("n"), preimage.alias("preimage"), F.expr("children[0].hash").alias("only"),
                     *([F.expr(f"transform(children, x -> struct({', '.join('x.' + c for c in carried)}))").alias("children")] if carried else []))
    return slim.withColumn("hash", F.coalesce(F.sha2("preimage", 256), "only")).drop("only")


def build(nodes: DataFrame, name: str, *carried: str) -> Tree:
    """The tree above nodes (grp, at, n, hash), with `carried` columns of theirs kept in levels[0]."""
    levels = [stored(_parents(nodes, *carried), f"{name}-1")]
    most = levels[0].agg(F.max("n")).first()[0] or 1
    while most > 1:
        levels.append(stored(_parents(levels[-1].where("n > 1")), f"{name}-{len(levels) + 1}"))
        most = -(-most // FAN)
    return Tree(levels)


def _descended(tree: Tree, above: DataFrame) -> DataFrame:
    """levels[0] with `path`, from the node itself up: an array of (preimage, slot). above: (grp, path, ...) for the groups'
    subroots, whose further columns come along."""
    own = [c for c in above.columns if c not in ("grp", "path")]
    down = None
    for level in reversed(tree.levels):
        found = level.where("n = 1").join(above, "grp")
        if down is not None:
            up = down.select("grp", F.col("at").alias("_up"), F.col("preimage").alias("_above"), F.col("path").alias("_path"), *own)
            rest = level.where("n > 1").withColumn("_up", F.floor(F.col("at") / FAN).cast("long")).join(up, ["grp", "_up"])
            step = F.array(F.struct(F.col("_above").alias("preimage"), (F.col("at") % FAN).cast("int").alias("slot")))
            found = found.unionByName(rest.withColumn("path", F.concat(step, "_path")).drop("_up", "_above", "_path"))
        down = found
    return down


def paths(rows: DataFrame, name: str = "merkle") -> DataFrame:
    """(grp, key, leaf, now, path, subroot, root) of rows (grp, key, hash, now): path has the preimages from the leaf's parent
    to the root and the leaf's slot in each."""
    slim = stored(rows, f"{name}-leaves")
    tree = build(ranked(slim, f"{name}-sorted", "key", "hash"), name, "key", "now")
    # the subroots' own tree has one group
    tops = ranked(tree.subroots().select(F.lit("").alias("grp"), F.col("grp").alias("key"), "hash"), f"{name}-subroots", "key")
    top = build(tops.withColumn("subroot", F.col("hash")), f"{name}-top", "key", "subroot")
    root = top.subroots().select("grp", F.array().cast("array<struct<preimage:string,slot:int>>").alias("path"), F.col("hash").alias("root"))
    discard(slim)
    groups = _leaves(_descended(top, root), "root").select(F.col("key").alias("grp"), "path", "subroot", "root")
    return _leaves(_descended(tree, groups), "grp", "subroot", "root")


def _leaves(parents: DataFrame, *keep: str) -> DataFrame:
    """The children of parents, each with its leaf and its path."""
    each = parents.select("preimage", "hash", "path", *(c for c in keep if c in parents.columns), F.posexplode("children").alias("slot", "child"))
    step = F.array(F.struct("preimage", F.col("slot").cast("int").alias("slot")))
    leaf = F.coalesce(F.expr(f"substring(preimage, {DIGEST} * slot + 1, {DIGEST})"), F.col("hash"))
    path = F.when(F.col("preimage").isNull(), F.col("path")).otherwise(F.concat(step, "path"))
    return each.select(*keep, "child.*", leaf.alias("leaf"), path.alias("path"))


def siblings() -> Column:
    """The hashes of the siblings on `path`, level by level, left to right: each preimage without its slot."""
    return F.expr(f"array_join(transform(path, x -> concat(substring(x.preimage, 1, {DIGEST} * x.slot), substring(x.preimage, {DIGEST} * (x.slot + 1) + 1))), '')")


def folded(leaf: str) -> Column:
    """The root that follows from a leaf: spliced into its slot, hashed, and so on upwards."""
    return F.expr(f"aggregate(path, {leaf}, (h, x) -> sha2(overlay(x.preimage PLACING h FROM {DIGEST} * x.slot + 1 FOR {DIGEST}), 256))")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = {c: F.col(c) for c in _FIELDS}
    leaf = digest(*fields.values())
    tampered = digest(*(fields | {"text": F.translate("text", _UPPER, _UPPER.lower())}).values())
    now = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered)  # null where nothing changes
    found = paths(leaves(documents, "lang", "doc_id", leaf, now))
    out = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), folded("coalesce(now, leaf)").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle() -> str:
    crc_row = "list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)"
    crc = "xor(list_reduce(list_transform(range(1, length(s) + 1), lambda k: CAST(ascii(s[k]) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    whole = lambda text: "sha256(" + " || ".join(value(c if c != "text" else text) for c in _FIELDS) + ")"
    tree = lambda grp: f"""SELECT {grp}, pos // {FAN} AS pos, (n + {FAN - 1}) // {FAN} AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h"""
    climb = lambda name, start: f"""{name}0 AS ({start}),
{name} AS (SELECT 0 AS lv, grp, pos, n, h FROM {name}0 UNION ALL
  SELECT lv + 1, grp, pos, n, h FROM (SELECT max(lv) AS lv, {tree('grp').removeprefix('SELECT ')} FROM {name} WHERE n > 1 GROUP BY grp, pos // {FAN}, n))"""  # noqa: E731
    # siblings and the fold of every leaf, level by level: (id, lv, node, h) climbs; subroots are leaves of the top
    step = lambda level, nodes: f"""SELECT w.id, w.lv + 1 AS lv, w.pos // {FAN} AS pos, w.grp,
  w.proof || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos <> w.pos), '') AS proof,
  sha256(string_agg(CASE WHEN x.pos = w.pos THEN w.h ELSE x.h END, '' ORDER BY x.pos)) AS h
  FROM {level} w JOIN {nodes} x ON x.grp = w.grp AND x.lv = w.lv AND x.pos // {FAN} = w.pos // {FAN} WHERE x.n > 1 GROUP BY w.id, w.lv, w.pos, w.grp, w.proof"""  # noqa: E731
    return f"""
WITH RECURSIVE crc AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, {crc_row} AS r FROM range(256) q(i))),
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS grp, {whole('text')} AS leaf, {whole(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} AS lowered, CAST(doc_id AS VARCHAR) AS s FROM documents),
e AS (SELECT d.*, CASE WHEN {crc} % 3 = 0 THEN lowered ELSE leaf END AS now, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d, crc),
{climb('low', 'SELECT grp, pos, n, leaf AS h FROM e')},
sub AS (SELECT grp, h FROM low WHERE n = 1),
{climb('high', "SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, h FROM sub")},
root AS (SELECT h AS root FROM high WHERE n = 1),
slot AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS pos FROM sub),
up AS (SELECT id, 0::BIGINT AS lv, pos, grp, '' AS proof, now AS h FROM e UNION ALL ({step('up', 'low')})),
mid AS (SELECT id, arg_max(proof, lv) AS proof, arg_max(h, lv) AS h, any_value(grp) AS grp FROM up GROUP BY id),
over_ AS (SELECT id, 0::BIGINT AS lv, slot.pos, '' AS grp, proof, h FROM mid JOIN slot ON mid.grp = slot.grp UNION ALL ({step('over_', 'high')})),
last AS (SELECT id, arg_max(proof, lv) AS proof, arg_max(h, lv) AS h FROM over_ GROUP BY id)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, last.h AS folded_root, last.h = root AS verified
FROM e JOIN sub ON sub.grp = e.grp JOIN last ON last.id = e.id, root
"""


ORACLE_SQL = _oracle()
