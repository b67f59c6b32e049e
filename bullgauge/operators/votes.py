"""Scored segments -> votes: the latest score of each segment, readable ones, one vote per house, product and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bullgauge.functions.products import sector_of


def latest_scores(scores: DataFrame, by_version: bool = True) -> DataFrame:
    """The row with the greatest id of each segment (in each version). Aggregation, so it combines before the shuffle; rows delivered twice fall together."""
    keys = ["segment_id", *(["model_version"] if by_version else [])]
    cols = [c for c in scores.columns if c not in keys]
    return scores.groupBy(*keys).agg(F.max_by(F.struct(*cols), "id").alias("s")).select(*keys, "s.*")


def scored_segments(report: DataFrame, segment: DataFrame, score: DataFrame, org: DataFrame, by_version: bool = True, wide: bool = False) -> DataFrame:
    """One row per scored segment (and version) with the columns that aggregation reads; ``wide`` adds those that only pages show (an argmax carries all its columns, so the narrow form keeps texts out of the shuffles). Reports of an unknown house have no vote; the trade date is the day of intake, never of publication."""
    last = latest_scores(score.select("id", "segment_id", "direction", "confidence", "model_version", *(["evidence"] if wide else [])), by_version)
    return (
        segment.select(F.col("id").alias("segment_id"), "report_id", "product_code", "sector", "seq", *(["product_name"] if wide else []))
        .join(last.drop("id"), "segment_id")
        .join(report.select(F.col("id").alias("report_id"), "org_id", "ingest_time", *(["title", "publish_time"] if wide else [])), "report_id")
        .join(org.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id")
        .drop("org_id")
        .withColumn("product_code", F.nullif(F.trim("product_code"), F.lit("")))
        .withColumn("trade_date", F.to_date("ingest_time"))
        .withColumn("direction", F.col("direction") + F.lit(0.0))  # no negative zero
    )


def readable(scored: DataFrame) -> DataFrame:
    """Without the rows that no rule could read (confidence 0 or null): unread is not neutral."""
    return scored.filter(F.coalesce("confidence", F.lit(0.0)) > 0)


def one_vote(rows: DataFrame) -> DataFrame:
    """The newest row of each house, product (null: macro, a group of its own) and day; ties by report, then segment. An argmax aggregate: a house with a third of all rows is combined before the shuffle."""
    keys = [*(["model_version"] if "model_version" in rows.columns else []), "org_name", "product_code", "trade_date"]
    cols = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*cols), F.struct("ingest_time", "report_id", "segment_id"))
    return rows.groupBy(*keys).agg(best.alias("v")).select(*keys, "v.*")


def votes(report: DataFrame, segment: DataFrame, score: DataFrame, org: DataFrame, by_version: bool = True) -> DataFrame:
    """The vote set; an unreadable newer note does not displace a readable older one."""
    return one_vote(readable(scored_segments(report, segment, score, org, by_version))).withColumn("sector", F.coalesce("sector", sector_of(F.col("product_code"))))


def ranked_votes(rows: DataFrame) -> DataFrame:
    """All rows with their rank in their (house, product, day); rank 1 votes."""
    w = Window.partitionBy("model_version", "org_name", "product_code", "trade_date").orderBy(F.desc("ingest_time"), F.desc("report_id"), F.desc("segment_id"))
    return rows.withColumn("rank", F.row_number().over(w))
