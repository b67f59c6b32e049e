"""Votes, levels, trends: hand-made rows with known results."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bullgauge.operators import levels, trends, votes
from bullgauge.plans import catalog

COLS = "org_name string, product_code string, sector string, trade_date date, ingest_time timestamp_ntz, report_id long, segment_id long, direction double, confidence double, model_version string"


def rows(spark, spec):
    """(house, product, direction, day, hour, confidence)."""
    out = []
    for k, (o, p, d, *rest) in enumerate(spec):
        day, hour, conf = (*rest, *[9, 7, 0.8][len(rest) :])
        t = datetime(2026, 9, day, hour)
        out.append((o, p, {"CU": "有色", "AL": "有色", "ZN": "有色", "LC": "能化", "MA": "能化", "RB": "黑色", "SC": "能化"}.get(p), t.date(), t, k, k, float(d), float(conf), "rule-v1"))
    return spark.createDataFrame(out, COLS)


def index(spark, spec, **kw):
    return levels.index_levels(votes.one_vote(votes.readable(rows(spark, spec))), **kw)


def one(df, level, key):
    return df.filter((F.col("level") == level) & (F.col("key") == key)).first()


def test_newest_note_votes(spark):
    r = one(index(spark, [("A", "CU", 2, 9, 7), ("A", "CU", -2, 9, 13)]), "product", "CU")
    assert (r.bull_count, r.bear_count, r.coverage_count, r.net_score) == (0, 1, 1, -100.0)


def test_unread_does_not_displace(spark):
    r = one(index(spark, [("A", "CU", 2, 9, 7), ("A", "CU", 0, 9, 13, 0.0)]), "product", "CU")
    assert (r.bull_count, r.neutral_count) == (1, 0)


def test_counts_and_cutoffs(spark):
    r = one(index(spark, [("A", "CU", 1), ("B", "CU", 1), ("C", "CU", -1), ("D", "CU", 0)]), "product", "CU")
    assert (r.bull_count, r.bear_count, r.neutral_count, r.net_score) == (2, 1, 1, 25.0)
    r = one(index(spark, [("A", "CU", 0.25), ("B", "CU", -0.25), ("C", "CU", 0.5), ("D", "CU", -0.5)]), "product", "CU")
    assert (r.bull_count, r.bear_count, r.neutral_count, r.net_score) == (1, 1, 2, 0.0)


def test_sector_pools_votes_and_market_counts_macro(spark):
    i = index(spark, [("A", "LC", -2)] + [(o, "MA", 2) for o in "BCDE"] + [("F", None, -2)])
    assert one(i, "sector", "能化").net_score == 60.0
    m = one(i, "market", "MARKET")
    assert (m.bull_count, m.bear_count, m.coverage_count) == (4, 2, 6)
    assert {r.key for r in i.filter("level = 'product'").collect()} == {"LC", "MA"}


def test_weighted(spark):
    assert one(index(spark, [("A", "CU", 1), ("B", "CU", 1), ("C", "CU", 1), ("D", "CU", -1)], bear_weight=1.3), "product", "CU").net_score == 42.5
    assert one(index(spark, [("A", "CU", -1)], bear_weight=1.3), "product", "CU").net_score == -100.0


@pytest.mark.parametrize(("net", "score"), [(-100.0, 0.0), (0.0, 50.0), (100.0, 100.0), (33.3, 66.7), (0.1, round(100.1 / 2, 1))])
def test_market_score(spark, net, score):
    assert spark.createDataFrame([(net,)], "n double").select(levels.market_score(F.col("n"))).first()[0] == score


def test_baseline(spark):
    b = levels.baseline(rows(spark, [("A", "CU", 2), ("A", "AL", 0.5), ("B", "CU", 1), ("B", "AL", -1), ("C", "CU", -2)])).first()
    assert (b.bull_orgs, b.bear_orgs, b.tie_orgs, b.net) == (1, 1, 1, 0.0)
    assert levels.baseline(rows(spark, [])).count() == 0


def test_previous_is_the_index_date(spark):
    i = index(spark, [("A", "CU", 2, 9), ("A", "RB", 2, 10)])
    c = {(r.key, r.trade_date.day): r for r in trends.compare_previous(i).collect()}
    assert c["RB", 10].prev_net is None and c["RB", 10].delta is None and c["CU", 9].prev_date is None
    assert c["MARKET", 10].delta == 0.0


def test_movers_and_divergence(spark):
    i = index(spark, [("A", "CU", -2, 9), ("A", "RB", 2, 9), ("A", "CU", 2, 10), ("A", "RB", 0, 10), ("A", "SC", 1, 10)])
    assert [(r.key, r.delta) for r in trends.top_movers(i).orderBy("rank").collect()] == [("CU", 200.0), ("RB", -100.0)]
    votes_ = [(f"a{k}", "SC", 1) for k in range(4)] + [(f"b{k}", "SC", -1) for k in range(5)] + [(f"c{k}", "CU", 1) for k in range(2)] + [(f"d{k}", "CU", -1) for k in range(2)] + [(f"e{k}", "RB", 1) for k in range(4)]
    assert [r.key for r in trends.most_divergent(index(spark, votes_)).orderBy("rank").collect()] == ["SC", "CU"]


def test_series_ends_at_the_day(spark):
    i = index(spark, [("A", "CU", 1, d) for d in range(1, 29)])
    s = trends.index_series(i, "market", "MARKET", 5, "2026-09-10").collect()
    assert [r.trade_date for r in s] == [date(2026, 9, d) for d in range(6, 11)]


def test_latest_score_takes_each_version(spark):
    s = spark.createDataFrame([(1, 7, 1.0, "v1"), (1, 7, 1.0, "v1"), (2, 7, -1.0, "v1"), (3, 7, 2.0, "v2")], "id long, segment_id long, direction double, model_version string")
    assert {(r.model_version, r.id) for r in votes.latest_scores(s).collect()} == {("v1", 2), ("v2", 3)}
    assert votes.latest_scores(s, by_version=False).first().id == 3


def test_matrix_of_all_houses(spark, sf):
    """No product vote of any house is lost."""
    queries = catalog.queries()
    orgs = [r[0] for r in spark.read.parquet(f"{sf}/org.parquet").orderBy("id").select("name").collect()]
    out = queries["stance_matrix_all"](spark, sf)
    assert out.columns[3:] == [f"c{k}" for k in range(len(orgs))] and len(orgs) > 8
    got = {(r.model_version, r.trade_date, r.product_code, orgs[k]): r[f"c{k}"] for r in out.collect() for k in range(len(orgs)) if r[f"c{k}"]}
    sign = lambda d: "++" if d >= 1.5 else "+" if d > 0.25 else "--" if d <= -1.5 else "-" if d < -0.25 else "·"
    votes_ = queries["vote_dedupe"](spark, sf).filter("product_code IS NOT NULL").collect()
    assert got == {(v.model_version, v.trade_date, v.product_code, v.org_name): sign(v.direction) for v in votes_} and len({k[3] for k in got}) > 8
