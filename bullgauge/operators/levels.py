"""Votes -> index at product, sector and market level, and the naive baseline."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bullgauge.settings import DEFAULT, Settings


def tally(s: Settings = DEFAULT) -> list[Column]:
    """bull, bear, neutral counts; the cut-offs are strict."""
    d = F.coalesce("direction", F.lit(0.0))
    bull, bear = d > s.bull_cutoff, d < s.bear_cutoff
    return [F.count_if(bull).alias("bull_count"), F.count_if(bear).alias("bear_count"), F.count_if(~bull & ~bear).alias("neutral_count")]


def net_score(bull: Column, bear: Column, neutral: Column, bear_weight: float = 1.0) -> Column:
    """(bull - weight x bear) / all x 100, within +-100, one decimal, ties to even; 0 without votes."""
    whole = bull + bear + neutral
    share = (bull - bear * F.lit(float(bear_weight))) / whole * 100
    return F.when(whole == 0, 0.0).otherwise(F.bround(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), share)), 1))


@lru_cache(1)
def half_table() -> tuple[float, ...]:
    """Market score of every possible net score, by the rule of correctly rounded decimals."""
    return tuple(round((n / 10 + 100) / 2, 1) for n in range(-1000, 1001))


def market_score(net: Column) -> Column:
    """(net + 100) / 2, one decimal."""
    return F.get(F.array(*map(F.lit, half_table())), F.round((net + 100) * 10).cast("int"))


def label(score: Column) -> Column:
    """Name of a market score."""
    return F.when(score >= 70, "明显偏多").when(score >= 60, "偏多").when(score <= 30, "明显偏空").when(score <= 40, "偏空").otherwise("中性")


def index_levels(votes: DataFrame, s: Settings = DEFAULT, bear_weight: float | None = None) -> DataFrame:
    """trade_date, level, key, net_score, counts, coverage_count, model_version, calc_version of all days in one pass: grouping sets over one scan. Product and sector levels skip votes without one; the market level counts all."""
    sets = [["model_version", "trade_date", "product_code"], ["model_version", "trade_date", "sector"], ["model_version", "trade_date"]]
    rows = votes.withColumn("sector", F.when(F.col("product_code").isNotNull(), F.nullif(F.trim("sector"), F.lit(""))))
    g = rows.groupingSets([[F.col(c) for c in x] for x in sets], "model_version", "trade_date", "product_code", "sector")
    out = g.agg(*tally(s), F.countDistinct("org_name").alias("coverage_count"), F.grouping("product_code").alias("no_product"), F.grouping("sector").alias("no_sector"))
    level = F.when(F.col("no_product") == 0, "product").when(F.col("no_sector") == 0, "sector").otherwise("market")
    key = F.when(F.col("no_product") == 0, F.col("product_code")).when(F.col("no_sector") == 0, F.col("sector")).otherwise("MARKET")
    net = net_score(F.col("bull_count"), F.col("bear_count"), F.col("neutral_count"), s.bear_weight if bear_weight is None else bear_weight)
    return out.select("trade_date", level.alias("level"), key.alias("key"), net.alias("net_score"), "bull_count", "bear_count", "neutral_count", "coverage_count", "model_version", F.lit(s.calc_version).alias("calc_version")).filter("key IS NOT NULL")


def baseline(readable: DataFrame) -> DataFrame:
    """trade_date, model_version, orgs, bull_orgs, bear_orgs, tie_orgs, blocks, net: each house votes by majority of its blocks' signs, a tie is neutral; null without houses."""
    by = readable.groupBy("model_version", "trade_date", "org_name").agg(F.count_if(F.col("direction") > 0).alias("up"), F.count_if(F.col("direction") < 0).alias("down"), F.count("*").alias("blocks"))
    out = by.groupBy("model_version", "trade_date").agg(
        F.count("*").alias("orgs"), F.count_if(F.col("up") > F.col("down")).alias("bull_orgs"), F.count_if(F.col("up") < F.col("down")).alias("bear_orgs"), F.count_if(F.col("up") == F.col("down")).alias("tie_orgs"), F.sum("blocks").alias("blocks")
    )
    return out.withColumn("net", F.bround(F.try_divide((F.col("bull_orgs") - F.col("bear_orgs")) * F.lit(100.0), F.col("orgs")), 1))


def baseline_vs_index(readable: DataFrame, index: DataFrame) -> DataFrame:
    """The baseline's net beside the market's, and their difference."""
    market = index.filter("level = 'market'").select("model_version", "trade_date", F.col("net_score").alias("index_net"))
    return baseline(readable).join(market, ["model_version", "trade_date"], "left").withColumn("diff", F.bround(F.col("index_net") - F.col("net"), 1))


def pooled_net(index: DataFrame) -> DataFrame:
    """The market's net from the product rows alone, unweighted and unrounded: what a page shows where the market row is missing."""
    p = index.filter("level = 'product'").groupBy("model_version", "trade_date").agg(F.sum("bull_count").alias("b"), F.sum("bear_count").alias("s"), F.sum(F.col("bull_count") + F.col("bear_count") + F.col("neutral_count")).alias("n"))
    return p.select("model_version", "trade_date", F.try_divide((F.col("b") - F.col("s")).cast("double") * 100, F.col("n").cast("double")).alias("net"))


def org_hits(votes: DataFrame) -> DataFrame:
    """Product votes per house and day; a house with macro votes only has 0."""
    return votes.groupBy("model_version", "trade_date", "org_name").agg(F.count("product_code").alias("hits"))


def day_counts(votes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """votes, product votes, low-confidence product votes, products, houses of each day."""
    product = F.col("product_code").isNotNull()
    return votes.groupBy("model_version", "trade_date").agg(
        F.count("*").alias("opinions"), F.count_if(product).alias("product_opinions"), F.count_if(product & (F.col("confidence") < s.low_confidence)).alias("low_confidence"), F.countDistinct("product_code").alias("products"), F.countDistinct("org_name").alias("orgs")
    )


def matrix(votes: DataFrame, orgs: list[str], s: Settings = DEFAULT) -> DataFrame:
    """House by product of each day: ++ + . - --, blank where no house spoke. The houses are given (a fixed small table), so the pivot needs no extra pass."""
    d = F.col("direction")
    sign = F.when(d >= s.strong_cutoff, "++").when(d > s.bull_cutoff, "+").when(d <= -s.strong_cutoff, "--").when(d < s.bear_cutoff, "-").otherwise("·")
    return votes.filter("product_code IS NOT NULL").withColumn("sign", sign).groupBy("model_version", "trade_date", "product_code").pivot("org_name", orgs).agg(F.first("sign"))
