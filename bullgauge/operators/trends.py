"""Index rows over time: the previous index date, changes, movers, divergence, alerts, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bullgauge.operators.levels import market_score
from bullgauge.settings import DEFAULT, Settings

_VERSION = ["model_version", "calc_version"]


def index_dates(index: DataFrame) -> DataFrame:
    """Each version's distinct dates, with the one before: of the index, not of a key."""
    days = index.select(*_VERSION, "trade_date").distinct()
    return days.withColumn("prev_index_date", F.lag("trade_date").over(Window.partitionBy(*_VERSION).orderBy("trade_date")))


def compare_previous(index: DataFrame) -> DataFrame:
    """Each row with the same key's row on the previous index date; nulls where there is none, never 0."""
    own = Window.partitionBy(*_VERSION, "level", "key").orderBy("trade_date")
    last = {n: F.lag(c).over(own) for n, c in (("last_date", "trade_date"), ("last_net", "net_score"))}
    rows = index.select(*_VERSION, "trade_date", "level", "key", "net_score", "coverage_count").withColumns(last)
    out = rows.join(index_dates(index), [*_VERSION, "trade_date"])
    met = F.col("last_date") == F.col("prev_index_date")  # the key's previous row is of the previous index date
    out = out.withColumns({"prev_date": F.when(met, F.col("last_date")), "prev_net": F.when(met, F.col("last_net"))}).drop("last_date", "last_net", "prev_index_date")
    delta = F.bround(F.col("net_score") - F.col("prev_net"), 1)
    score, prev = market_score(F.col("net_score")), market_score(F.col("prev_net"))
    return out.withColumns({"delta": delta, "score": score, "prev_score": prev}).withColumn("delta_score", F.bround(F.col("score") - F.col("prev_score"), 1))


def _top(rows: DataFrame, n: int, *order) -> DataFrame:
    w = Window.partitionBy(*_VERSION, "trade_date").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_movers(index: DataFrame, n: int = 3) -> DataFrame:
    """The n products of each day that moved most since the previous index date; none on the first."""
    moved = compare_previous(index).filter("level = 'product' AND delta IS NOT NULL AND delta <> 0")
    return _top(moved.select(*_VERSION, "trade_date", "key", "net_score", "prev_net", "delta"), n, F.desc(F.abs("delta")), "key")


def most_divergent(index: DataFrame, n: int = 3) -> DataFrame:
    """The n products of each day with the most votes on the weaker of two sides."""
    split = index.filter("level = 'product' AND bull_count > 0 AND bear_count > 0").select(*_VERSION, "trade_date", "key", "net_score", "bull_count", "bear_count")
    return _top(split, n, F.desc(F.least("bull_count", "bear_count")), F.abs("net_score"), "key")


def index_series(index: DataFrame, level: str, key: str, limit: int = 30, end_date: str | None = None) -> DataFrame:
    """The last ``limit`` rows of a key up to a date, oldest first; gaps stay gaps."""
    rows = index.filter((F.col("level") == level) & (F.col("key") == key))
    if end_date:
        rows = rows.filter(F.col("trade_date") <= F.lit(end_date).cast("date"))
    return rows.orderBy(F.desc("trade_date")).limit(limit).orderBy("trade_date")


def alerts(index: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Days whose market score calls for a message: on the first day its place, else a threshold crossed or a large move."""
    m = compare_previous(index).filter("level = 'market'")
    up, down = F.col("score") >= s.bull_threshold, F.col("score") <= s.bear_threshold
    first = F.col("prev_score").isNull()
    why = F.array(
        F.when(first & up, "bull"), F.when(first & down, "bear"),
        F.when(~first & up & (F.col("prev_score") < s.bull_threshold), "cross_up"), F.when(~first & down & (F.col("prev_score") > s.bear_threshold), "cross_down"),
        F.when(F.abs("delta_score") >= s.alert_delta, "jump"),
    )
    return m.withColumn("reasons", F.array_join(F.filter(why, lambda x: x.isNotNull()), ",")).filter("reasons <> ''").select(*_VERSION, "trade_date", "score", "delta_score", "reasons")
