"""The inbox as a stream: each new file once, by the MD5 of its content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bullgauge.sources import inbox


def note_stream(spark: SparkSession, folder: str, channel: str = "inbox", now: str | None = None) -> DataFrame:
    """Notes of the files that arrive in a folder; a content is a note once, for a watermark of 30 days of file times."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{txt,md,markdown,html,htm,pdf}").load(folder)
    files = files.withColumn("md5", F.md5("content")).withWatermark("modificationTime", "30 days").dropDuplicatesWithinWatermark(["md5"])
    return inbox.notes(files.select("path", "content"), channel, now).filter("parse_status = 'pending'")


def ingest_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, **options) -> StreamingQuery:
    """All files that are there now, appended to a Parquet table; the checkpoint remembers them."""
    return note_stream(spark, folder, **options).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
