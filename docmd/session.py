"""Sessions: makes this package importable on the executors of a session that somebody else started."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application, and bounds what workers get at once."""
    if spark.conf.get(_ROWS) == "10000":  # Spark's default: of texts that is tens of MB in each worker
        spark.conf.set(_ROWS, "4000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(top.parent))), p.read_bytes())
    folder = tempfile.mkdtemp(prefix="docmd-")
    path = os.path.join(folder, "docmd_package.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df over all cores, where it has fewer splits than there are: for work that is heavy on each row of a small table. A
    table of more splits stays as it is. With rows, a table of more than so many a core is dealt to tasks of them at most, in
    whole rounds of the cores: its splits may be of any size, or empty."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None and (rounds := -(-df.count() // (rows * cores))) > 1:
        return df.repartition(rounds * cores)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the folder that `spark.checkpoint.dir` names, which all executors share; in local mode one
    of this machine where none is named."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docmd-")
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/docmd/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = (path,)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the tables that were written for df, which can't be read again then."""
    for where in getattr(df, "scratch", ()):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
