"""Pending notes -> their text and status."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bullgauge.functions.text import garbled_ratio, normalize_text, read_file
from bullgauge.settings import DEFAULT, Settings
from bullgauge.sources.spread import spread

SCHEMA = "file_md5 string, parse_status string, parsed_text string, reason string"


def _judged(raw: DataFrame, s: Settings) -> DataFrame:
    """file_md5, text, reason of reading -> status, text and reason of parsing."""
    text, share = normalize_text(F.col("text")), garbled_ratio(F.col("text"))
    reason = F.when(F.col("reason") != "", F.col("reason")).when(F.col("text") == "", "empty text").when(share > s.max_garbled_ratio, F.concat(F.lit("乱码 "), F.round(share * 100).cast("int"), F.lit("%")))
    out = raw.withColumn("text", text).withColumn("reason", reason)
    return out.select("file_md5", F.when(F.col("reason").isNull(), "ok").otherwise("failed").alias("parse_status"), F.when(F.col("reason").isNull(), F.col("text")).alias("parsed_text"), "reason")


_RAW = "file_md5 string, text string, reason string"


def _batch(keys: pa.Array, got: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.record_batch([keys, pa.array([t for t, _ in got], pa.string()), pa.array([r for _, r in got], pa.string())], names=["file_md5", "text", "reason"])


def parse(files: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """file_md5, parse_status (ok, failed), parsed_text, reason of file_md5, path, content. Decoding is Python over Arrow; everything after is SQL. A file that can't be read never stops the others; the reason stands in a column of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(b.column(0), [read_file(p, c) for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])

    return _judged(files.select("file_md5", "path", "content").mapInArrow(run, _RAW), s)


def content(path: str) -> bytes | None:
    """The bytes of a file of any store; None where there is none. Only the store goes into a URI, as names of files need no escapes here."""
    scheme, colon, rest = path.partition(":")
    try:
        if not colon or scheme == "file":
            system, at = fs.LocalFileSystem(), f"/{rest.lstrip('/')}" if colon else path
        else:
            host, _, name = rest.lstrip("/").partition("/")
            system, root = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{host}")
            at = f"{root.rstrip('/')}/{name}"
        with system.open_input_file(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def parse_paths(paths: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """As ``parse``, of file_md5, path: each task opens its own files, so no other file of their folders is read and no content is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(b.column(0), [read_file(p, content(p)) for p in b.column(1).to_pylist()])

    return _judged(spread(paths.select("file_md5", "path")).mapInArrow(run, _RAW), s)


def parse_counts(parsed: DataFrame) -> DataFrame:
    """total, ok, failed, dependency_missing."""
    missing = F.coalesce(F.col("reason").startswith("dependency missing"), F.lit(False))
    return parsed.agg(F.count("*").alias("total"), F.count_if(F.col("parse_status") == "ok").alias("ok"), F.count_if((F.col("parse_status") == "failed") & ~missing).alias("failed"), F.count_if(missing).alias("dependency_missing"))
