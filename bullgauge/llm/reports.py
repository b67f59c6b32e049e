"""The reports of each intake batch against all earlier ones: bodies, history, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bullgauge.llm import boiler, history, repair
from bullgauge.llm.shared import written

_DOCS_A_RANGE = 2_000_000


def repaired(reports: DataFrame, batches: DataFrame) -> DataFrame:
    """id, batch_no, file_md5, source, text (repaired lines), lines (hashes of their forms, 0 for a blank one); no text for unreadable reports, no batch outside of all."""
    spans = batches.select("batch_no", "opened_at", "closed_at")
    rows = reports.select("id", "ingest_time", "file_md5", "org_id", "parse_status", "parsed_text")
    rows = rows.join(F.broadcast(spans), (F.col("ingest_time") >= F.col("opened_at")) & (F.col("ingest_time") < F.col("closed_at")), "left")  # the batches are a small fixed table
    rows = rows.select("id", F.col("batch_no").cast("int").alias("batch_no"), "file_md5", F.col("org_id").cast("long").alias("source"), F.when(F.col("parse_status") == "ok", F.col("parsed_text")).alias("text"))

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form: dict[str, int] = {}
        for b in got:
            texts, lines = [], []
            for t in b.column(4).to_pylist():
                if not t:
                    texts.append(None)
                    lines.append([])
                    continue
                if len(form) > 200_000:
                    form.clear()
                t = repair.comparable(t)
                own = []
                for x in t.split("\n"):
                    h = form.get(x)
                    if h is None:
                        f = repair.line_form(x)
                        h = form[x] = boiler._hash(f) if f else 0
                    own.append(h)
                texts.append(t)
                lines.append(own)
            yield pa.record_batch([*(b.column(i) for i in range(4)), pa.array(texts, pa.string()), pa.array(lines, pa.list_(pa.int64()))], names=["id", "batch_no", "file_md5", "source", "text", "lines"])

    return rows.mapInArrow(run, "id long, batch_no int, file_md5 string, source long, text string, lines array<long>")


def house_lines(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """line: the lines that any house prints on note after note."""
    return boiler.often(boiler.partial_of_lists(rows.withColumnRenamed("id", "doc")), sources).select("line").distinct()


def repeats(spark: SparkSession, reports: DataFrame, batches: DataFrame) -> DataFrame:
    """a, b for every report b of a batch after the first that repeats an earlier report; a is the first of them all."""
    rows = written(spark, repaired(reports, batches), "repaired")
    # at most (lines of a note / share) lines of each house
    drop = spark.sparkContext.broadcast(np.array(sorted(r[0] for r in house_lines(rows, boiler.sources(reports)).collect()), np.int64))

    def bodies(b: pa.RecordBatch, text: int, lines: int) -> list[str | None]:
        gone = set(drop.value.tolist())
        out = []
        for t, own in zip(b.column(text).to_pylist(), b.column(lines).to_pylist(), strict=True):
            out.append("\n".join(x for x, h in zip(t.split("\n"), own, strict=True) if h not in gone) if t else None)
        return out

    keys = written(spark, history.keyed(rows.select("id", F.coalesce("batch_no", F.lit(0)).alias("batch_no"), "file_md5", "text", "lines"), lambda b: bodies(b, 3, 4)), "keys", ["batch_no"])
    numbers = sorted(r[0] for r in keys.select("batch_no").distinct().collect())  # as many as there are batches
    splits = 1
    while splits * _DOCS_A_RANGE < keys.count() and splits < 1 << 16:
        splits *= 2
    past = history.History(spark, splits)
    found = history.copies(keys)
    for n in numbers:
        found = found.unionByName(past.add(keys.filter(F.col("batch_no") == n)))
    crowds = past.crowded()
    few, crowds = crowds.filter("crowd IS NULL").select("a", "b", F.lit(history.NEAR).alias("key_no")), crowds.filter("crowd IS NOT NULL")
    found = written(spark, found.unionByName(few).distinct(), "pairs")

    same = found.filter(F.col("key_no") < history.NEAR).select("a", "b")  # equal files and bodies need no look at the texts
    near = found.filter(F.col("key_no") == history.NEAR).select("a", "b").distinct()
    ids = written(spark, near.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowds.select(F.col("a").alias("id"))).distinct(), "ids")
    some = rows.filter("text IS NOT NULL").select("id", "text", "lines")
    some = some.join(F.broadcast(ids) if ids.count() <= history.MOST_IDS else ids, "id", "left_semi")

    def body(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            yield pa.record_batch([b.column(0), pa.array(bodies(b, 1, 2), pa.string())], names=["id", "body"])

    texts = some.mapInArrow(body, "id long, body string")
    alike = history.verified(near, texts)
    if not crowds.isEmpty():
        alike = alike.unionByName(history.alike_in_crowds(crowds, texts))
    first = history.first_of_all(spark, same.unionByName(alike))
    late = rows.filter("batch_no >= 1").select(F.col("id").alias("b"))
    return first.join(late, "b", "left_semi")
