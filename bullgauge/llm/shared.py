"""Tables kept for one job in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session gets one of its own (tests); on a cluster it is an error, as a folder of one machine would be read by the others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bullgauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders that ``written`` made in this process.
_MADE: list[str] = []


def written(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The table, written once and read again: short lineage, and an executor may be lost."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables written so far. For the end of a job: results that have not been read yet need them."""
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers that every executor can hold.
MOST_ROWS = 1_000_000


def small(spark: SparkSession, df: DataFrame, name: str, most: int = MOST_ROWS) -> DataFrame:
    """The table, written and counted: broadcast in joins if it is small, else left to a shuffle."""
    kept = written(spark, df, name)
    return F.broadcast(kept) if kept.count() <= most else kept
