"""Stance of advice texts: scale, negation, intensity, clauses, cascade."""

import pytest
from pyspark.sql import functions as F

from bullgauge import lexicon
from bullgauge.functions import stance

CASES = {
    2.0: "多头思路为主 以多头思路对待 坚定做多 建议做多 强烈看多 多头思路为主，回调无需过度看空。",
    -2.0: "空头思路为主 以空头思路对待 坚定做空 建议做空 强烈看空 操作上建议逢高沽空 空头思路为主，反弹勿追多。",
    1.0: "逢低偏多 逢低做多 偏多思路 逢低买入 多单入场 操作策略上逢低偏多 行情回顾：昨日震荡走高。操作建议：逢低偏多。",
    -1.0: "逢高沽空 逢高做空 偏空思路 逢高抛空 空单入场 高抛为主 不得不看空 不能不看空 不确定性上升，逢高沽空",
    0.5: "谨慎追空 暂不看空 前多保护利润 前多持有 逢低轻仓试多 不追空 切勿追空 不宜做空 不看空 不勿看空",
    -0.5: "不宜追高 暂不看多 前空持有 前空止盈 逢高轻仓试空 不追高 不追涨 勿追多 板块承压运行 不建议做多 不看多 略偏空",
    0.0: "区间操作 观望为主 高抛低吸 短差操作 暂时观望 多空交织 宽幅震荡 等待方向指引 高抛低吸，运行区间参考755-778。",
    0.6: "谨慎逢低偏多", 1.2: "大幅偏多", -0.6: "谨慎做空", 0.36: "谨慎小幅偏多",
}


@pytest.fixture(scope="module")
def said(spark):
    rows = [(t, d) for d, ts in CASES.items() for t in ts.split(" ")] + [(t, None) for t in ("昨日沪铜收涨0.8%，库存小幅去化。", "本文由某某研究所提供", "", "  ", None)] + [("逢 低 偏 多", 1.0)]
    df = spark.createDataFrame(rows, "t string, want double")
    return df.select("t", "want", stance.classify(F.col("t")).alias("r")).select("t", "want", "r.*").collect()


def test_directions(said):
    wrong = [(r.t, r.want, r.direction) for r in said if r.t != "不勿看空" and r.want != r.direction]
    assert not wrong


def test_negation_and_intensity(said):
    by = {r.t: r for r in said}
    assert by["不建议做多"].negated and by["不建议做多"].confidence == 0.55
    assert not by["不得不看空"].negated
    assert by["谨慎逢低偏多"].confidence == 0.69
    assert by["大幅偏多"].confidence == 0.86
    assert by["前多保护利润"].confidence < 0.6


def test_evidence_is_part_of_the_text(said):
    for r in said:
        if r.evidence:
            assert r.evidence.rstrip("…") in r.t
    assert "逢低偏多" in {r.t: r for r in said}["行情回顾：昨日震荡走高。操作建议：逢低偏多。"].evidence


def test_cascade(spark):
    rows = [("", "行情回顾：昨日跌3.2%。板块承压运行。操作建议：逢低偏多。", 1.0), ("", "行情回顾。震荡偏强。操作建议：逢高沽空", -1.0), ("", "库存累积。反弹乏力，逢低偏多对待", 1.0), ("", "价格重心下移", -0.5), (None, None, 0.0), ("逢低\n偏多", "", 1.0)]
    df = spark.createDataFrame(rows, "a string, r string, want double")
    got = df.select("want", stance.score_segment(F.col("a"), F.col("r")).alias("x")).select("want", "x.direction", "x.confidence").collect()
    assert [r.direction for r in got] == [r.want for r in got]
    assert got[4].confidence == 0.0 and got[3].confidence == 0.5


def test_round2_is_correctly_rounded(spark):
    values = [round(a * b, 12) for a in (0.5, 1.0, 2.0, 0.82, 0.575) for b in (0.36, 0.42, 0.6, 0.7, 1.15, 1.3, 1.495)] + [n / 1000 for n in range(5, 2000, 10)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", stance.round2(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [round(r.x, 2) for r in got]


def test_rule_table():
    assert len(lexicon.RULES) == 52 and len(lexicon.PRODUCTS) == 45 and len(lexicon.alias_index()) == 117
    assert all(abs(r.direction) <= 2 and 0 < r.confidence < 1 for r in lexicon.RULES)
