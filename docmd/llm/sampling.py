"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remainder(column: str, modulus: int):
    """crc32 of the column's text, modulo modulus; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def per_label(rows: DataFrame, label: str, key: str, bound: int) -> DataFrame:
    """At most `bound` rows of every label, those with the smallest hash of key; all rows where there are fewer.

    The labels are counted first, so that only about 1.3 * bound rows of a label reach the ranking.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    near = rows.join(F.broadcast(counts), label).withColumn("_r", rank).where(F.col("_r") <= F.lit(bound * 1.3 + 50) / F.col("_n"))
    order = Window.partitionBy(label).orderBy("_r", key)
    return near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= bound).drop("_n", "_r", "_k")
