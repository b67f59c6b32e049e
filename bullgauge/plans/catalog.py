"""Driver queries of the core over the tables of the stance index, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bullgauge import lexicon
from bullgauge.functions import products, stance, text
from bullgauge.operators import levels, segmenting, trends, votes
from bullgauge.plans import examples, sql
from bullgauge.settings import DEFAULT
from bullgauge.sources import inbox
from bullgauge.sources.spread import spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return votes.scored_segments(*(_t(spark, sf, n) for n in ("report", "segment", "score", "org")))


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return votes.votes(*(_t(spark, sf, n) for n in ("report", "segment", "score", "org")))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return levels.index_levels(_votes(spark, sf))


_KEY = ("model_version", "trade_date")
_COUNTS = ("net_score", "bull_count", "bear_count", "neutral_count", "coverage_count")


# ------------------------------------------------------------------ reads
@_query
def reports_with_org(spark, sf):
    r, o = _t(spark, sf, "report"), _t(spark, sf, "org")
    return r.join(F.broadcast(o.select(F.col("id").alias("org_id"), F.col("name").alias("org_name"))), "org_id").select("id", "org_name", "title", F.to_date("ingest_time").alias("trade_date"), "parse_status")


@_query
def pending_reports(spark, sf):
    return _t(spark, sf, "report").filter("parse_status = 'pending'").select("id", "title", "file_path")


@_query
def unsegmented(spark, sf):
    r, s = _t(spark, sf, "report"), _t(spark, sf, "segment")
    return r.filter("parse_status = 'ok'").join(s, r["id"] == s["report_id"], "left_anti").select("id", "title")


@_query
def unscored(spark, sf):
    """Segments without a score of the version rule-v2."""
    seg, sc = _t(spark, sf, "segment"), _t(spark, sf, "score").filter("model_version = 'rule-v2'")
    return seg.join(sc, seg["id"] == sc["segment_id"], "left_anti").select("id", "report_id", "seq")


@_query
def latest_score(spark, sf):
    return votes.latest_scores(_t(spark, sf, "score"), by_version=False).select("segment_id", "id", "direction", "confidence", "model_version")


@_query
def latest_score_by_version(spark, sf):
    return votes.latest_scores(_t(spark, sf, "score")).select("segment_id", "model_version", "id", "direction", "confidence")


@_query
def scored_segments(spark, sf):
    return _scored(spark, sf).select("segment_id", "report_id", "org_name", "product_code", "sector", "trade_date", "direction", "confidence", "model_version", "seq")


@_query
def table_counts(spark, sf):
    one = [_t(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("org", "report", "segment", "score")]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


@_query
def file_dedupe(spark, sf):
    """The first report of each file hash, case aside."""
    r = _t(spark, sf, "report").filter("file_md5 IS NOT NULL")
    return r.groupBy(F.lower("file_md5").alias("file_md5")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


# ------------------------------------------------------------------ votes
@_query
def readable_votes(spark, sf):
    return votes.readable(_scored(spark, sf)).groupBy(*_KEY).agg(F.count("*").alias("n"))


@_query
def vote_dedupe(spark, sf):
    return _votes(spark, sf).select(*_KEY, "org_name", "product_code", "sector", "report_id", "segment_id", "direction", "confidence")


@_query
def macro_votes(spark, sf):
    return _votes(spark, sf).filter("product_code IS NULL").select(*_KEY, "org_name", "segment_id", "direction")


@_query
def vote_ranks(spark, sf):
    return votes.ranked_votes(votes.readable(_scored(spark, sf))).groupBy("rank").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ index
@_query
def index_all_levels(spark, sf):
    return _index(spark, sf)


def _level(name: str) -> None:
    def q(spark, sf):
        return _index(spark, sf).filter(F.col("level") == name).select(*_KEY, "key", *_COUNTS)

    _QUERIES[f"index_{name}"] = q


for _name in ("market", "sector", "product"):
    _level(_name)


@_query
def weighted_index(spark, sf):
    return levels.index_levels(_votes(spark, sf), bear_weight=1.3).filter("level <> 'product'").select(*_KEY, "level", "key", "net_score")


@_query
def market_score(spark, sf):
    score = levels.market_score(F.col("net_score"))
    return _index(spark, sf).filter("level = 'market'").select(*_KEY, "net_score", score.alias("score"), levels.label(score).alias("label"))


@_query
def naive_baseline(spark, sf):
    return levels.baseline(votes.readable(_scored(spark, sf)))


@_query
def baseline_vs_index(spark, sf):
    return levels.baseline_vs_index(votes.readable(_scored(spark, sf)), _index(spark, sf)).select(*_KEY, "net", "index_net", "diff")


@_query
def org_hits(spark, sf):
    return levels.org_hits(_votes(spark, sf))


@_query
def day_counts(spark, sf):
    return levels.day_counts(_votes(spark, sf))


@_query
def low_confidence_queue(spark, sf):
    return _votes(spark, sf).filter(F.col("product_code").isNotNull() & (F.col("confidence") < DEFAULT.low_confidence)).select(*_KEY, "org_name", "product_code", "segment_id", "confidence")


@_query
def version_coexistence(spark, sf):
    return _index(spark, sf).groupBy("model_version", "calc_version", "level").agg(F.count("*").alias("rows"), F.countDistinct("trade_date").alias("days"))


@_query
def stance_matrix(spark, sf):
    """Every house of org (a fixed table), c0, c1, ... in order of the id."""
    orgs = [r[0] for r in _t(spark, sf, "org").orderBy("id").select("name").collect()]
    out = levels.matrix(_votes(spark, sf), orgs)
    return out.select(*_KEY, "product_code", *(F.coalesce(F.col(f"`{o}`"), F.lit("")).alias(f"c{k}") for k, o in enumerate(orgs)))


_QUERIES["stance_matrix_all"] = stance_matrix  # its name while stance_matrix had eight houses


# ------------------------------------------------------------------ trends
@_query
def index_dates(spark, sf):
    return trends.index_dates(_index(spark, sf)).select(*_KEY, "prev_index_date")


@_query
def latest_date(spark, sf):
    return _index(spark, sf).groupBy("model_version").agg(F.max("trade_date").alias("last"), F.min("trade_date").alias("first"))


@_query
def compare_previous(spark, sf):
    return trends.compare_previous(_index(spark, sf)).select(*_KEY, "level", "key", "net_score", "prev_date", "prev_net", "delta", "delta_score")


@_query
def top_movers(spark, sf):
    return trends.top_movers(_index(spark, sf)).select(*_KEY, "rank", "key", "delta")


@_query
def most_divergent(spark, sf):
    return trends.most_divergent(_index(spark, sf)).select(*_KEY, "rank", "key", "bull_count", "bear_count")


@_query
def alert_days(spark, sf):
    return trends.alerts(_index(spark, sf)).select(*_KEY, "score", "delta_score", "reasons")


@_query
def index_series(spark, sf):
    """The last 30 market rows up to a day: the limit is the feature."""
    return trends.index_series(_index(spark, sf).filter("model_version = 'rule-v1'"), "market", "MARKET", 30, "2026-06-30").select("trade_date", "net_score", "coverage_count")


# ------------------------------------------------------------------ texts
@_query
def normalize_text(spark, sf):
    return _t(spark, sf, "report").select("id", text.normalize_text(F.col("parsed_text")).alias("text"))


@_query
def garbled_ratio(spark, sf):
    return _t(spark, sf, "report").select("id", F.round(text.garbled_ratio(F.col("parsed_text")), 6).alias("ratio"))


@_query
def sentence_counts(spark, sf):
    return _t(spark, sf, "segment").select("id", F.size(text.sentences(F.col("raw_text"))).alias("sentences"))


@_query
def md5_keys(spark, sf):
    return _t(spark, sf, "report").select("id", F.md5("parsed_text").alias("md5"))


@_query
def filename_meta(spark, sf):
    m = inbox.filename_meta(F.col("file_path"))
    return _t(spark, sf, "report").select("id", m.alias("m")).select("id", "m.publish_time", "m.org_name", "m.title", "m.filename_ok")


@_query
def ingest_clock(spark, sf):
    r = _t(spark, sf, "report").filter("publish_time IS NOT NULL")
    return r.select("id", inbox.ingest_time(None, F.col("publish_time"), F.col("title")).alias("clock"))


@_query
def match_products(spark, sf):
    return _t(spark, sf, "report").select("id", F.array_join(products.match_products(F.col("title")), ",").alias("codes"))


@_query
def sector_of(spark, sf):
    return _t(spark, sf, "segment").select("id", products.sector_of(F.col("product_code")).alias("sector"))


@_query
def classify_advice(spark, sf):
    """Stance of the advice of all segments."""
    r = stance.classify(F.col("advice_text"))
    return spread(_t(spark, sf, "segment")).select("id", r.alias("r")).select("id", F.col("r.rule").alias("rule"), (F.col("r.direction") + F.lit(0.0)).alias("direction"), "r.confidence", "r.negated")


@_query
def advice_evidence(spark, sf):
    """The evidence of each stance, a part of the advice, and the words that the rule matched."""
    r = stance.classify(F.col("advice_text"))
    return spread(_t(spark, sf, "segment")).select("id", r.alias("r")).filter("r IS NOT NULL").select("id", "r.evidence", "r.matched")


@_query
def rule_hits(spark, sf):
    rule = stance._first_rule(stance.compact(F.col("advice_text")))
    return _t(spark, sf, "segment").groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


@_query
def intensity(spark, sf):
    return _t(spark, sf, "segment").select("id", stance.intensity(F.col("advice_text")).alias("factor"))


@_query
def negation(spark, sf):
    n = F.regexp_count(F.coalesce(stance.compact(F.col("advice_text")), F.lit("")), F.lit(stance._NEG))
    return _t(spark, sf, "segment").select("id", n.alias("negations"))


@_query
def pooled_net(spark, sf):
    return levels.pooled_net(_index(spark, sf))


@_query
def first_rule(spark, sf):
    """The first rule, in order, that fits the advice as a whole."""
    c = stance.compact(F.col("advice_text"))
    return _t(spark, sf, "segment").select("id", stance._first_rule(c).alias("rule"))


@_query
def score_segments(spark, sf):
    """Scores of all segments by the cascade of texts."""
    r = stance.score_segment(F.col("advice_text"), F.col("raw_text"))
    return spread(_t(spark, sf, "segment")).select("id", r.alias("r")).select("id", "r.direction", "r.confidence", "r.evidence")


@_query
def method_stats(spark, sf):
    """Hits, misses and stances of the rules per product."""
    r = stance.classify(F.col("advice_text"))
    x = spread(_t(spark, sf, "segment")).select("product_code", r.alias("r"))
    return x.groupBy("product_code").agg(F.count("*").alias("total"), F.count("r").alias("hit"), F.count_if(F.col("r.direction") > DEFAULT.bull_cutoff).alias("bull"), F.count_if(F.col("r.direction") < DEFAULT.bear_cutoff).alias("bear"))


@_query
def segment_notes(spark, sf):
    """Blocks of all readable reports."""
    r = spread(_t(spark, sf, "report")).filter("parse_status = 'ok'").select(F.col("id").alias("report_id"), text.normalize_text(F.col("parsed_text")).alias("t"))
    return segmenting.segment_notes(r, "report_id", "t")


def queries() -> dict[str, Query]:
    return _QUERIES | examples.QUERIES


def oracle_sql() -> dict[str, str]:
    known = sql.build(lexicon)
    return {k: v for k, v in known.items() if k in _QUERIES} | examples.SQL
