"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. A window is WINDOW
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document word
inside any occurrence of any window is hit.

Texts become arrays of word hashes; every run of GRAM words has a hash, and of every WINDOW - GRAM + 1
consecutive ones the smallest (the leftmost of equal ones) is kept with its place. Two texts that share WINDOW
words share such a minimum at the same place of the span, so the join of the kept hashes misses no shared
window. Every match is then extended: the windows that contain the matched words on both sides are compared
word by word. Items of fewer than WINDOW words are found by the hash of their whole sequence at every place of
a document, and compared as well.

A fingerprint goes with the words around it that its windows can hold, not with the whole item. The fingerprints are
broadcast when they are at most `broadcast_rows` and `broadcast_bytes`, both counted, else joined by a shuffle, in which
the adaptive skew join splits a fingerprint that many documents hold.
Items with equal words are one class. Null and empty texts have no words. Rows that share a doc_id (null
included) share their hits. Without items, or without documents, nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import stored

WINDOW, GRAM = 10, 5
_UPPER = "".join(map(chr, range(65, 91)))
_CUT = "".join(chr(c) for c in range(128) if not (48 <= c < 58 or 97 <= c < 123 or 65 <= c < 91))


def words(text: Column) -> Column:
    """The words of a text; null for null."""
    return F.array_remove(F.split(F.translate(text, _UPPER + _CUT, _UPPER.lower() + " " * len(_CUT)), " "), "")


def _hashes(words_: Column, n: int) -> Column:
    """A hash of the n words from each place on; null where there are fewer than n."""
    at = F.sequence(F.lit(0), F.size(words_) - n)
    return F.when(F.size(words_) >= n, F.transform(at, lambda i: F.xxhash64(*(F.get(words_, i + j) for j in range(n)))))


def winnowed(rows: DataFrame) -> DataFrame:
    """rows (..., w: words, h: word hashes) with (place, fp) of each kept minimum, both null for rows of fewer words than a window.

    GRAM words and WINDOW - GRAM + 1 grams are put together by twos, so that a place costs a few small steps.
    """
    by_two = lambda x, y, by, of: F.transform(x, lambda a, i: of(a, F.get(y, i + by)))
    mixed, least = lambda a, b: F.xxhash64(a, b), lambda a, b: F.least(a, b)
    # a gram's number is 32 bits of its hash, then its place: the smallest of a span is the leftmost of equal hashes, and is the
    # same number in all spans that keep it. What the arrays' ends lack is cut off twice: before minima, and at last
    numbered = lambda a, i: F.xxhash64(a, F.get("h", i + GRAM - 1)).bitwiseAND(F.lit(-1 << 32).cast("long")) + i
    steps = {
        "g": by_two("h", "h", 1, mixed), "g4": by_two("g", "g", 2, mixed), "grams": F.slice(F.transform("g4", numbered), 1, F.size("h") - GRAM + 1),
        "m": by_two("grams", "grams", 1, least), "m4": by_two("m", "m", 2, least), "kept": F.array_distinct(F.slice(by_two("m4", "m", 4, least), 1, F.size("h") - WINDOW + 1)),
    }
    # rows of few words are not filtered out: a filter would split their texts once more, as explode would
    long = rows.withColumn("h", F.when(F.size("w") >= WINDOW, F.col("h")))
    for name, made in steps.items():
        long = long.withColumn(name, made)
    marked = long.drop("h", *(x for x in steps if x != "kept")).withColumn("k", F.explode_outer("kept"))
    return marked.withColumns({"place": F.col("k").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"), "fp": F.shiftright("k", 32)}).drop("k", "kept")


def _with_words(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    split = rows.select(F.col(key).alias(name), words(F.col(text)).alias("w"))
    return split.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def hits(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", broadcast_rows: int = 500_000, broadcast_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(id, start, length, class) of every occurrence of a window, and (class, items) with the items of each class."""
    split = _with_words(items, item_key, item_text, "item").where(F.size("w") > 0).withColumn("class", F.sha2(F.concat_ws(" ", "w"), 256))
    kinds = stored(split.groupBy("class").agg(F.first("w").alias("iw"), F.first("h").alias("h"), F.collect_set(F.col("item").cast("string")).alias("items")), "decontaminate-items")
    spread = WINDOW - GRAM
    before = F.greatest(F.col("place") - spread, F.lit(0))
    marks = winnowed(kinds.select("class", F.col("iw").alias("w"), "h")).where("fp is not null").select(
        "class", F.slice("w", before + 1, F.col("place") - before + WINDOW).alias("iw"), (F.col("place") - before).alias("iplace"), "fp"
    )
    marks = stored(marks, "decontaminate-marks")
    docs = _with_words(documents, key, text, "id")

    def matched(rows: DataFrame, start: Column, length: Column, known: DataFrame) -> DataFrame:
        """rows with the words from start on, joined with the marks of the benchmark."""
        part = F.slice("w", start + 1, length).alias("part")
        own = [c for c in rows.columns if c != "w"]
        size = F.sum(F.aggregate("iw", F.lit(160).cast("long"), lambda a, x: a + F.octet_length(x) + 24))
        n, held = known.agg(F.count(F.lit(1)), size).first()
        if n <= broadcast_rows and (held or 0) <= broadcast_bytes:
            joined = rows.join(F.broadcast(known), "fp")
            return joined.select(*own, part, *(c for c in known.columns if c != "fp"))
        return rows.select(*own, part).join(known, "fp")

    first = F.greatest(F.col("place") - spread, F.lit(0))
    near = matched(winnowed(docs), first, F.col("place") - first + WINDOW, marks)
    fits = F.filter(
        F.sequence(F.lit(0), F.least("place", "iplace", F.lit(spread))),
        lambda o: (F.size(F.slice("iw", F.col("iplace") - o + 1, WINDOW)) == WINDOW)
        & (F.slice("part", F.col("place") - o - first + 1, WINDOW) == F.slice("iw", F.col("iplace") - o + 1, WINDOW)),
    )
    found = near.withColumn("o", F.explode_outer(fits)).where("o is not null").select("id", (F.col("place") - F.col("o")).alias("start"), F.lit(WINDOW).alias("length"), "class")
    short = kinds.where(F.size("iw") < WINDOW)
    for n in sorted(r[0] for r in short.select(F.size("iw")).distinct().collect()):  # at most WINDOW - 1 lengths
        known = short.where(F.size("iw") == n).select("class", "iw", F.xxhash64(*(F.get("h", F.lit(j)) for j in range(n))).alias("fp"))
        at = docs.where(F.size("w") >= n).withColumn("g", _hashes(F.col("h"), n)).drop("h").select("id", "w", F.posexplode_outer("g").alias("place", "fp"))
        near = matched(at, F.col("place"), F.lit(n), known)
        found = found.unionByName(near.where("part = iw").select("id", F.col("place").alias("start"), F.lit(n).alias("length"), "class"))
    return found, kinds.select("class", "items")


def summary(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items) of every row of documents: its words, those hit, and the items (as sorted strings) with occurring windows."""
    found, kinds = hits(documents, items, key, text, item_key, item_text)
    found = stored(found.distinct(), "decontaminate-hits")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    add = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")
    )
    covered = found.groupBy("id").agg(spans.alias("s")).select("id", F.aggregate("s", zero, add)["n"].alias("n_hit"))
    named = found.select("id", "class").distinct().join(kinds, "class").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = stored(covered.join(named, covered["id"].eqNullSafe(named["id"])).select(covered["id"].alias("hit_id"), "n_hit", "items"), "decontaminate-found")
    base = documents.select(F.col(key).alias("id"), F.coalesce(F.size(words(F.col(text))), F.lit(0)).alias("n_words"))
    return base.join(both, F.col("id").eqNullSafe(F.col("hit_id")), "left").select(
        "id", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return summary(documents, items).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
