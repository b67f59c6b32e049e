"""A folder of notes -> rows of the notes table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from bullgauge.settings import CHANNELS, DEFAULT, INBOX_SUFFIXES, INTRADAY_HINTS, UNKNOWN_ORG, Settings

SCHEMA = "file_md5 string, publish_time date, org_name string, title string, filename_ok boolean, ingest_time timestamp_ntz, trade_date date, source_channel string, file_path string, parse_status string"


def date_token(token: Column) -> Column:
    """yyyyMMdd or year, month and day by the same sign of - . / ; null if that is no date."""
    parts = F.regexp_extract_all(token, F.lit(r"^(\d{4})[-./]?(\d{1,2})[-./]?(\d{1,2})$"), 0)
    ok = token.rlike(r"^\d{4}(\d{1,2}\d{1,2}|-\d{1,2}-\d{1,2}|\.\d{1,2}\.\d{1,2}|/\d{1,2}/\d{1,2})$")
    at = lambda k: F.regexp_extract(token, r"^(\d{4})[-./]?(\d{1,2})[-./]?(\d{1,2})$", k)
    return F.when(ok & (F.size(parts) > 0), F.try_to_timestamp(F.concat_ws("-", at(1), F.lpad(at(2), 2, "0"), F.lpad(at(3), 2, "0")), F.lit("yyyy-MM-dd")).cast(DateType()))


def filename_meta(path: Column) -> Column:
    """Struct of publish_time, org_name, title, filename_ok of a name like 20260908_house_title.txt; a first part that looks like a date but is none is dropped."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    stem = F.trim(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    parts = F.filter(F.transform(F.split(stem, "_"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.try_element_at(parts, F.lit(1))
    day = date_token(first)
    dated = F.coalesce(day.isNotNull() | first.rlike(r"^\d{4}[-./]?\d{1,2}[-./]?\d{1,2}$"), F.lit(False))
    rest = F.when(dated, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    n = F.size(rest)
    org = F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit(UNKNOWN_ORG))
    title = F.when(n > 1, F.array_join(F.slice(rest, 2, F.greatest(n, F.lit(1))), "_")).when(n == 1, org).otherwise(F.when(stem != "", stem).otherwise(name))
    return F.struct(day.alias("publish_time"), org.alias("org_name"), title.alias("title"), (day.isNotNull() & (n >= 2)).alias("filename_ok"))


def normalize_now(now: str | None) -> str | None:
    """A day alone means the backfill clock; ISO times to seconds."""
    if not now:
        return None
    if len(now) == 10:
        return f"{now} {DEFAULT.backfill_clock}"
    return datetime.fromisoformat(now).replace(tzinfo=None).isoformat(" ", "seconds")


def ingest_time(now: str | None, publish_time: Column, title: Column, s: Settings = DEFAULT) -> Column:
    """The run's time if given; else the day of publication at the backfill clock, at noon for intraday notes; else the present."""
    if now:
        return F.lit(normalize_now(now)).cast("timestamp_ntz")
    clock = F.when(title.rlike("|".join(INTRADAY_HINTS)), s.intraday_clock).otherwise(s.backfill_clock)
    return F.coalesce(F.concat_ws(" ", publish_time.cast("string"), F.when(publish_time.isNotNull(), clock)).try_cast("timestamp_ntz"), F.localtimestamp())


def list_folder(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """(accepted, skipped) names of a folder, without sub-folders and dot files, each sorted. Listed by the file system, so any store that Spark reads will do, and empty files count."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return [], []
    names = sorted(f.getPath().getName() for f in system.listStatus(path) if f.isFile() and not f.getPath().getName().startswith("."))
    ok = [n for n in names if n.lower().endswith(INBOX_SUFFIXES)]
    return ok, [n for n in names if n not in ok]


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the accepted files."""
    ok, _ = list_folder(spark, folder)
    if not ok:
        return spark.createDataFrame([], "path string, content binary")
    sub = "*.{" + ",".join(sorted({n.rpartition(".")[2] for n in ok})) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", sub).load(folder).select("path", "content")


def notes(files: DataFrame, channel: str = "inbox", now: str | None = None) -> DataFrame:
    """Rows of the notes table of path, content: keyed by the MD5 of the content; an empty file is failed."""
    if channel not in CHANNELS:
        raise ValueError(f"channel must be one of {CHANNELS}")
    rows = files.withColumn("m", filename_meta(F.col("path"))).select(F.md5("content").alias("file_md5"), "m.*", F.lit(channel).alias("source_channel"), F.col("path").alias("file_path"), F.when(F.length("content") == 0, "failed").otherwise("pending").alias("parse_status"))
    rows = rows.withColumn("ingest_time", ingest_time(now, F.col("publish_time"), F.col("title")))
    rows = rows.withColumn("trade_date", F.to_date("ingest_time"))
    return rows.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])


def new_notes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One note per MD5 (the first file name) that is not known yet."""
    w = Window.partitionBy("file_md5").orderBy("file_path")
    firsts = rows.filter("parse_status = 'pending'").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return firsts.join(known.select("file_md5"), "file_md5", "left_anti").select(*rows.columns)


def fetch_from_website(org: str) -> DataFrame:
    """Adapter point for site connectors; none is built in."""
    raise NotImplementedError(f"no connector for {org}")
