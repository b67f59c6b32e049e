"""Files to index, run twice; names, decoding, stream, page."""

import pytest
from pyspark.sql import functions as F

from bullgauge import cli
from bullgauge.functions import text
from bullgauge.sources import inbox
from bullgauge.sources.store import Store
from bullgauge.streaming import inbox as stream

NOTE = "【有色】沪铜\n库存去化。\n操作建议：逢低偏多。\n【黑色】螺纹钢\n需求回落。\n操作建议：逢高沽空。"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("inbox")
    (d / "20260908_甲期货_商品日报.txt").write_text(NOTE, encoding="utf-8")
    (d / "20260909_乙期货_商品日报.txt").write_bytes(NOTE.replace("逢低偏多", "逢高沽空").encode("gb18030"))
    (d / "20260909_丙期货_午间_早评.html").write_text("<html><head><meta charset=utf-8><title>x</title></head><body><p>【沪铜】</p><p>操作建议：坚定做多。</p><p>【沪铝】</p><p>操作建议：观望为主。</p></body></html>", encoding="utf-8")
    (d / "20260910_甲期货_重复.txt").write_text(NOTE, encoding="utf-8")
    (d / "20260910_丁期货_坏.txt").write_bytes(bytes((k * 7 + 3) % 32 for k in range(2000)))
    (d / "20260910_丁期货_表.xlsx").write_bytes(b"x")
    (d / "空.txt").write_bytes(b"")
    return str(d)


def test_pipeline(spark, folder, tmp_path):
    s = Store(spark, f"file://{tmp_path}/wh")
    assert s.ingest(folder) == {"new": 4, "duplicated": 1, "failed": 1, "skipped_format": 1}
    out = s.pipeline()
    assert out["parse"] == {"total": 4, "ok": 3, "failed": 1, "dependency_missing": 0}
    assert out["segment"]["segments"] == 6 and out["score"] == {"scored": 6, "hit": 6}
    assert "乱码" in s.table("note_text").filter("parse_status = 'failed'").first().reason
    days = {r.trade_date.isoformat(): r for r in s.index().filter("level = 'market'").collect()}
    assert days["2026-09-08"].net_score == 0.0 and days["2026-09-09"].coverage_count == 2
    again = s.ingest(folder)
    assert again["new"] == 0
    out = s.pipeline()
    assert out["segment"]["segments"] == 0 and out["score"]["scored"] == 0 and out["aggregate"]["index_rows"] == s.count("daily_index")
    assert s.score("rule-v2")["scored"] == 6 and s.count("scores") == 12
    with pytest.raises(ValueError):
        s.count("nothing")


def test_cli(spark, folder, tmp_path, capsys):
    args = ["--warehouse", f"file://{tmp_path}/wh"]
    assert cli.run(spark, [*args, "show"]) == 1
    assert cli.run(spark, [*args, "demo", "--inbox", folder, "--out", str(tmp_path / "d.html")]) == 0
    page = (tmp_path / "d.html").read_text(encoding="utf-8")
    assert page.startswith("<!doctype html>") and "<script" not in page and "丙期货" in page
    capsys.readouterr()
    for c in ("push", "matrix", "status"):
        assert cli.run(spark, [*args, c]) == 0
    out = capsys.readouterr().out
    assert "大盘情绪" in out and "图例" in out and "daily_index" in out


def test_stream(spark, folder, tmp_path):
    table = f"{tmp_path}/t"
    for _ in range(2):
        stream.ingest_stream(spark, folder, table, f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(table).count() == 4


def test_names(spark):
    want = {
        "in/20260908_永安期货_商品日报.txt": ("2026-09-08", "永安期货", "商品日报", True), "20260908_永安期货.txt": ("2026-09-08", "永安期货", "永安期货", False), "永安期货_商品日报.txt": (None, "永安期货", "商品日报", False),
        "20261301_永安期货_日报.txt": (None, "永安期货", "日报", False), "随手命名.txt": (None, "随手命名", "随手命名", False), "_.txt": (None, "未知机构", "_", False), "2026-09-08_甲_早评_有色.txt": ("2026-09-08", "甲", "早评_有色", True),
    }
    got = spark.createDataFrame([(k,) for k in want], "p string").select("p", inbox.filename_meta(F.col("p")).alias("m")).collect()
    for r in got:
        assert (r.m.publish_time and r.m.publish_time.isoformat(), r.m.org_name, r.m.title, r.m.filename_ok) == want[r.p]


def test_decoding():
    assert text.decode("沪铜".encode("gb18030")) == "沪铜" and text.decode(b"\xef\xbb\xbfab") == "ab"
    assert text.html_text("<head><meta charset=x><title>t</title></head><p>a&nbsp;b<br>c<script>d</script>").split() == ["a", "b", "c"]
    assert text.read_file("x.pdf", b"no pdf")[1] and text.read_file("x.doc", b"")[1] == "unsupported format"


def test_normalize(spark):
    df = spark.createDataFrame([("a\r\nb  \n\n\n\nc　",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.normalize_text(F.col("t"))).collect()] == ["a\nb\n\nc", None, ""]


def test_versions_stand_side_by_side(spark, folder, tmp_path):
    from dataclasses import replace

    from bullgauge.settings import DEFAULT

    root = f"file://{tmp_path}/wh"
    one = Store(spark, root)
    assert one.pipeline()["segment"] == {"reports": 0, "segments": 0, "product": 0, "macro": 0, "multi": 0, "empty": 0}
    one.ingest(folder)
    made = one.pipeline()
    assert made["segment"] == {"reports": 3, "segments": 6, "product": 6, "macro": 0, "multi": 0, "empty": 0}
    assert {r[0] for r in one.table("orgs").collect()} == {"甲期货", "乙期货", "丙期货", "丁期货"}
    counts = one.score_counts()
    assert counts == {"total": 6, "hit": 6, "miss": 0, "hit_rate": 1.0, "low_confidence": 0, "bull": 2, "bear": 3, "neutral": 1}
    n = one.count("daily_index")
    two = Store(spark, root, replace(DEFAULT, calc_version="netscore-v2", bear_weight=2.0))
    two.aggregate()
    two.aggregate()
    assert one.count("daily_index") == 2 * n and one.index().count() == two.index().count() == n
    one.score("rule-v2")
    one.aggregate()
    assert one.index("rule-v2").count() == n and two.index().count() == n
    rows = one.read_index("2026-09-09", "product").collect()
    assert [r.key for r in rows] == [r.key for r in sorted(rows, key=lambda r: (-r.net_score, r.key))] and {r.level for r in rows} == {"product"}
    assert one.read_index("2030-01-01").count() == 0


def test_views_of_a_day():
    from datetime import date

    from bullgauge.render import day as view

    row = lambda level, key, net, **k: {"level": level, "key": key, "net_score": net, "score": (net + 100) / 2, "prev_net": 0.0, "prev_date": date(2026, 9, 8), "delta_score": 5.0, "bull_count": 3, "bear_count": 1, "neutral_count": 0, "coverage_count": 4} | k
    move = [{"key": "CU", "prev_net": -50.0, "net_score": 50.0}]
    d = view.Day(date(2026, 9, 9), row("market", "MARKET", 50.0), [row("sector", "有色", 50.0)], [row("product", "CU", 50.0)], {}, [], [], None, move, [], "", {"opinions": 4, "low": 0}, ("rule-v1", "netscore-v1"), 2)
    said = view.push_message(d)
    assert "（2 家转多）" in said and "对照  NA" in said
    d.turned = -1
    assert "（1 家转空）" in view.push_message(d)
    assert "\033[31m" in view.terminal(d, color=True) and "\033[" not in view.terminal(d)
    assert view.two_sided(-50.0, 4) == "  ██│" and view.two_sided(100.0, 4) == "    │████"
    page = view.html_page(d)
    assert "<footer>" in page and "对照 NA" in page
    d.market = None
    assert "按 1 个品种合并：净得分 +50.0" in view.push_message(d)
    d.products = []
    assert "不产出数字" in view.push_message(d)
