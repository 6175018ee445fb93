"""Files as they arrive: the same conversion on a file stream. Rows are independent, so there is no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmd.plans.convert import to_markdown
from docmd.session import discard

_FILES = "path string, modificationTime timestamp, length long, content binary"


def read(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """The files that come into a folder, as documents."""
    rows = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", per_batch).load(path)
    return rows.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.lit(None).cast("string").alias("source_uri"), "length", "content")


def convert(spark: SparkSession, source: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Converts the files that come into `source` to Parquet rows in `target`, partitioned by batch.

    A batch that is run again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = to_markdown(batch)
        try:
            out.write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            discard(out)

    writer = read(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
