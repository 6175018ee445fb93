"""The corpus pipeline: language ID, line dedup, near-duplicates, benchmark decontamination, SentencePiece.

Every stage takes (spark, docs, sf_dir), with docs the rows that the stage before it kept, and returns a
DataFrame; all but the last return the columns of `documents`. Each is fitted on, and judges, its own input.
A null doc_id is kept by every filter that needs one; null and empty texts are rejected by language ID.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm import decontaminate, langid, linedup, neardup, piecebpe
from docmd.llm.common import lookup, stored, told_apart
from docmd.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model accepts."""
    ship(spark)
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left go."""
    ship(spark)
    rest = linedup.without_repeats(docs).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return rest.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


#: Bits of the number of a row. Fewer only make more rows share one at first.
ROW_BITS = 63


def _with_row(docs: DataFrame) -> DataFrame:
    """docs with `_row`, which exactly those rows share that have equal doc_id and text (by 128 bits of the text): an id
    alone may have several texts."""
    tag = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))
    own = docs.withColumns({"_node": F.xxhash64("doc_id", "text").bitwiseAND(F.lit(((1 << ROW_BITS) - 1) * 2 if ROW_BITS < 63 else -2)), "_tag": tag})
    _, clashing = told_apart(own.select("_node", "_tag"), "_node", "_tag", (), "pipeline-rows")
    if clashing is None:
        return own.drop("_tag").withColumnRenamed("_node", "_row")
    ids = clashing.select("_node", "_tag", F.col("id").alias("_row"), F.col("n").alias("_rows"))
    return lookup(own, ids, ["_node", "_tag"], own.count(), "_rows", "left").withColumn("_row", F.coalesce("_row", "_node")).select(*docs.columns, "_row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (of several texts, the smallest `_row`), once. Of rows
    with equal doc_id and text the one with the smallest other columns stays."""
    ship(spark)
    own = _with_row(docs.where("doc_id is not null"))
    found = neardup.near_duplicates(own, key="_row").select("id", "component").distinct()
    members = stored(found.join(own.select(F.col("_row").alias("id"), "doc_id").distinct(), "id"), "pipeline-groups")
    keepers = members.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = stored(lookup(members, keepers, "component", members.count(), "n").where(F.col("id") != F.col("keeper.id")).select(F.col("id").alias("_row")), "pipeline-copies")
    kept = own.join(gone.hint("merge"), "_row", "left_anti")
    once = kept.groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("kept")).select("kept.*")
    return once.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window."""
    ship(spark)
    own = _with_row(docs)
    found, _ = decontaminate.hits(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_row")
    gone = stored(found.select(F.col("id").alias("_row")).distinct(), "pipeline-hits")
    return own.join(gone, "_row", "left_anti").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, their number, and whether they decode to its text."""
    ship(spark)
    return piecebpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), ("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language ID, fuzzy lines and merge-dropout have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
