"""Queries of the llm operators. SQL can express none of them (their texts go through automata, tag paths, a tokenizer or a factorization first), so tests hold them against brute force, public libraries, round trips and labels instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bullgauge import lexicon
from bullgauge.llm import boiler, encode, history, lookalike, mixture, repair, reports, subjects
from bullgauge.llm.shared import written
from bullgauge.sources.spread import spread


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(_table(spark, sf, name))


def _readable(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, "report").filter("parse_status = 'ok'")


# ------------------------------------------------------------------ 1
def _repeated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    every = _texts(spark, sf, "report")
    found = boiler.report_lines(spark, every)
    return found, boiler.repeated(found, boiler.sources(every))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found, lines = _repeated(spark, sf)
    return boiler.places(found, lines).select(F.col("doc").alias("report_id"), F.col("line_no").cast("long").alias("line_no"))


def p1_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The repeated lines of each house, by hash, with the exact number of their reports."""
    _, lines = _repeated(spark, sf)
    return lines.select(F.col("source").alias("org_id"), F.col("line").alias("line_hash"), "docs", "variants").distinct()  # a row for each bucket


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Each readable report without the repeated lines."""
    found, lines = _repeated(spark, sf)
    return boiler.without(_readable(spark, sf), "id", "parsed_text", boiler.places(found, lines)).select(F.col("doc").alias("report_id"), "text")


# ------------------------------------------------------------------ 2
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return repair.restore_encoding(_readable(spark, sf), "id", "parsed_text").select(F.col("key").alias("report_id"))


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    return repair.restore_encoding(_readable(spark, sf), "id", "parsed_text").select(F.col("key").alias("report_id"), "text")


# ------------------------------------------------------------------ 3
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return repair.marked(_readable(spark, sf), "id", "parsed_text", "org_id").select(F.col("key").alias("report_id"))


def p3_plain(spark: SparkSession, sf: str) -> DataFrame:
    return repair.strip_markup(_readable(spark, sf), "id", "parsed_text", "org_id").select(F.col("key").alias("report_id"), "text", "kinds")


# ------------------------------------------------------------------ 4
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return reports.repeats(spark, _texts(spark, sf, "report"), _table(spark, sf, "intake_batch")).select(F.col("a").alias("report_id_a"), F.col("b").alias("report_id_b"))


# ------------------------------------------------------------------ 5
def _views(spark: SparkSession, sf: str) -> DataFrame:
    texts = _readable(spark, sf).select(F.lit("report").alias("table_name"), F.col("id").alias("row_id"), F.col("parsed_text").alias("text"))
    segments = _texts(spark, sf, "segment").select(F.lit("segment").alias("table_name"), F.col("id").alias("row_id"), F.col("raw_text").alias("text"))
    return texts.unionByName(segments)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    views = _views(spark, sf)
    found = lookalike.found(views, ["table_name", "row_id"], "text")
    odd = lookalike.odd_rows(views.filter("table_name = 'report'"), "text")
    garbled = repair.restore_encoding(odd, "row_id", "text").select(F.lit("report").alias("table_name"), F.col("key").alias("row_id"))
    return found.join(garbled, ["table_name", "row_id"], "left_anti")


def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All texts in one form."""
    views = _views(spark, sf)
    new = lookalike.unify(views, ["table_name", "row_id"], "text")
    out = views.join(new, ["table_name", "row_id"], "left")
    return out.select("table_name", "row_id", F.coalesce("unified", "text").alias("text"))


# ------------------------------------------------------------------ 6
def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.ids(spark, _texts(spark, sf, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "ids")


# ------------------------------------------------------------------ 7
def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = _table(spark, sf, "mix_target")
    sized = written(spark, encode.sizes(spark, _texts(spark, sf, "documents"), ["doc_id", "source"], "text"), "sizes")
    return mixture.mix(sized, targets, "doc_id"), targets


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, n_ids, copies of each document in the mixture."""
    return _mixture(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the tokens that each listed source reached."""
    return mixture.shares(*_mixture(spark, sf))


# ------------------------------------------------------------------ 8
def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    names: dict[str, list[str]] = {}
    for p in lexicon.PRODUCTS:  # the dictionary's products anchor the areas that are named like its sectors
        names.setdefault(p.sector, []).extend(p.aliases)
    more = F.try_element_at(F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, "\n".join(v)))), "name_zh")
    areas = _table(spark, sf, "subject_area").withColumn("scope", F.concat_ws("\n", "scope", more))
    return subjects.subjects(spark, _texts(spark, sf, "documents"), _table(spark, sf, "subject_label"), areas)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per subject, and the subject's part of the corpus by the documents' shares."""
    found = _subjects(spark, sf).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("weight"))
    whole = found.agg(F.sum("weight").alias("whole"))
    return found.join(F.broadcast(whole)).select("subject", "documents", (F.col("weight") / F.col("whole")).alias("part"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_lines, p1_clean, p2_found, p2_restored, p3_found, p3_plain, p4_found, p5_found, p5_unified, p6_ids, p7_mixture, p7_shares, p8_found, p8_composition)}


def oracle_sql() -> dict[str, str]:
    """None, see above."""
    return {}
