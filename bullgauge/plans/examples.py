"""Operators on texts whose results are known: every row of a table gets one of them by its id, and the SQL has the known result as a literal.

The results here are written down from the definitions, not computed, so a wrong rule or number cannot hide on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bullgauge.functions import products, stance, text
from bullgauge.operators import levels, segmenting
from bullgauge.sources import inbox, parsing
from bullgauge.sources.spread import spread

STANCE = {
    2.0: ["多头思路为主", "以多头思路对待", "坚定做多", "建议做多", "强烈看多", "多头思路为主，回调无需过度看空。"],
    -2.0: ["空头思路为主", "以空头思路对待", "坚定做空", "建议做空", "强烈看空", "操作上建议逢高沽空", "空头思路为主，反弹勿追多。"],
    1.0: ["逢低偏多", "逢低做多", "偏多思路", "逢低买入", "多单入场", "逢 低 偏 多", "操作策略上逢低偏多", "行情回顾：昨日震荡走高。操作建议：逢低偏多。"],
    -1.0: ["逢高沽空", "逢高做空", "偏空思路", "逢高抛空", "空单入场", "高抛为主", "不得不看空", "不能不看空", "不确定性上升，逢高沽空"],
    0.5: ["谨慎追空", "暂不看空", "前多保护利润", "前多持有", "逢低轻仓试多", "不追空", "切勿追空", "不宜做空", "不看空", "难以看空"],
    -0.5: ["不宜追高", "暂不看多", "前空持有", "前空止盈", "逢高轻仓试空", "不追高", "不追涨", "勿追多", "板块承压运行", "不建议做多", "不看多", "略偏空", "难以多头思路为主", "短期难以形成多头格局", "不以多头思路为主"],
    0.0: ["区间操作", "观望为主", "高抛低吸", "短差操作", "暂时观望", "多空交织", "宽幅震荡", "等待方向指引", "高抛低吸，运行区间参考 755-778。"],
    0.6: ["谨慎逢低偏多"], 1.2: ["大幅偏多"], -0.6: ["谨慎做空"], 0.36: ["谨慎小幅偏多"],
    None: ["昨日沪铜收涨0.8%，库存小幅去化。", "本文由某某研究所提供", "", " "],
}
#: text -> (evidence, matched words)
EVIDENCE = {
    "行情回顾：昨日震荡走高。操作建议：逢低偏多。": ("操作建议：逢低偏多", "逢低偏多"),
    "逢 低 偏 多": ("逢 低 偏 多", "逢 低 偏 多"),
    "库存去化。PTA 偏多思路为主！": ("PTA 偏多思路为主", "偏多思路为主"),
    "不建议做多": ("不建议做多", "建议做多"),
    "今日" + "甲" * 60 + "，建议观望为主，等待": ("建议观望为主", "建议观望为主"),
}
#: (advice, block) -> (direction, confidence)
CASCADE = {
    ("", "行情回顾：昨日跌3.2%。板块承压运行。操作建议：逢低偏多。"): (1.0, 0.82),
    ("", "行情回顾。震荡偏强。操作建议：逢高沽空"): (-1.0, 0.82),
    ("", "库存累积。反弹乏力，逢低偏多对待"): (1.0, 0.82),
    ("", "价格重心下移"): (-0.5, 0.5),
    ("逢低\n偏多", ""): (1.0, 0.8),  # a line feed ends a clause, so the words after it speak
    ("谨慎逢低偏多", "逢高沽空"): (0.6, 0.69),
    ("", ""): (0.0, 0.0),
}
PRODUCTS = {
    "氧化铝现货松动，沪铝维持高位": "AO,AL", "螺纹钢领涨，随后沪铜跟涨，最后铁矿石补涨": "RB,CU,I", "炼焦煤库存回升": "JM", "热轧卷板": "HC", "pta 加工费走扩": "TA", "RB 主力合约": "RB", "CAPTAIN": "", "XPVCY": "", "A JAIC report": "",
    "RB2601 合约": "", "增量资金进场，银行间流动性宽松": "", "": "", "硅铁矿石": "I", "锰硅铁": "SF", "沪金属硅": "SI", "花生猪": "LH",
}
_COPPER = "【有色】沪铜\n库存持续去化。\n操作建议：逢低偏多。"
_REBAR = "【黑色】螺纹钢\n需求回落。\n操作建议：观望为主。"
_GOLD = "[多品种合并块｜2 个品种：沪金、沪银｜以下原文为这些品种共享，未能按段落拆开]\n【贵金属】沪金沪银\n昨日沪金沪银同步走强，避险升温。\n操作建议：暂不看空。"
_MACRO = "【宏观】市场综述\n今日原油领涨，商品普遍走强，资金流入明显，情绪回暖，原油再创新高。操作建议：谨慎逢低偏多。"
#: note -> its blocks as (product, sector, advice, text)
NOTES = {
    f"{_COPPER}\n{_REBAR}": [("CU", "有色", "逢低偏多。", _COPPER), ("RB", "黑色", "观望为主。", _REBAR)],
    f"【有色】沪铜、沪铝\n沪铜：库存去化，操作建议：逢低偏多。\n沪铝：成本塌陷，操作建议：逢高沽空。\n{_REBAR}": [
        ("CU", "有色", "逢低偏多。", "【有色】沪铜、沪铝\n沪铜：库存去化，操作建议：逢低偏多。"), ("AL", "有色", "逢高沽空。", "【有色】沪铜、沪铝\n沪铝：成本塌陷，操作建议：逢高沽空。"), ("RB", "黑色", "观望为主。", _REBAR),
    ],
    f"【贵金属】沪金沪银\n昨日沪金沪银同步走强，避险升温。\n操作建议：暂不看空。\n{_REBAR}": [("AU", "贵金属", "暂不看空。", _GOLD), ("AG", "贵金属", "暂不看空。", _GOLD), ("RB", "黑色", "观望为主。", _REBAR)],
    f"{_MACRO}\n{_COPPER}": [(None, None, "谨慎逢低偏多。", _MACRO), ("CU", "有色", "逢低偏多。", _COPPER)],
    f"{_COPPER}\n{_REBAR}\n\n免责声明：本报告不构成投资建议，据此操作，风险自担。": [("CU", "有色", "逢低偏多。", _COPPER), ("RB", "黑色", "观望为主。", _REBAR)],
    "## 沪铜\n走强。\n## 沪铝\n走弱。": [("CU", "有色", "走强。", "## 沪铜\n走强。"), ("AL", "有色", "走弱。", "## 沪铝\n走弱。")],
    "一、沪铜\n走强。\n二、沪铝\n走弱。": [("CU", "有色", "走强。", "一、沪铜\n走强。"), ("AL", "有色", "走弱。", "二、沪铝\n走弱。")],
    "沪铜走强。\n库存去化。\n沪铝走弱。": [("CU", "有色", "库存去化。", "沪铜走强。\n库存去化。"), ("AL", "有色", "沪铝走弱。", "沪铝走弱。")],
    "【沪铜】上期\n操作建议：逢高沽空。\n【沪铝】\n操作建议：观望为主。\n【沪铜】本期\n操作建议：逢低偏多。": [("CU", "有色", "逢低偏多。", "【沪铜】上期\n操作建议：逢高沽空。\n\n【沪铜】本期\n操作建议：逢低偏多。"), ("AL", "有色", "观望为主。", "【沪铝】\n操作建议：观望为主。")],
    f"{_COPPER}\n【展望】后市\n库存仍在去化，下游需求逐步恢复，成本支撑较强，关注宏观数据的指引与资金的动向。\n操作建议：逢高沽空。": [("CU", "有色", "逢高沽空。", f"{_COPPER}\n【展望】后市\n库存仍在去化，下游需求逐步恢复，成本支撑较强，关注宏观数据的指引与资金的动向。\n操作建议：逢高沽空。")],
    "   ": [],
}
PAGES = {
    "<head><meta charset=x><title>t</title></head><p>a&nbsp;b<br>c<script>d</script>": "\na\xa0b\nc",
    "<html><body><h1>标题</h1><table><tr><td>甲</td><td>乙</td></tr></table><style>x{}</style></body></html>": "\n标题\n\n\n 甲 乙\n\n",
    "plain": "plain",
    "": "",
}
#: name, content as hexadecimal -> status, what stands in the reason, text
FILES = [
    ("a.txt", "沪铜".encode("gb18030").hex(), "ok", None, "沪铜"), ("b.txt", b"\xef\xbb\xbfab".hex(), "ok", None, "ab"), ("c.md", "铝\r\n\r\n\r\n\r\n锌  ".encode().hex(), "ok", None, "铝\n\n锌"), ("d.html", "<p>铜<p>铝".encode().hex(), "ok", None, "铜\n铝"),
    ("e.txt", "", "failed", "empty text", None), ("f.doc", "00", "failed", "unsupported format", None), ("g.txt", bytes((k * 7 + 3) % 8 for k in range(50)).hex(), "failed", "乱码 100%", None),
]
NAMES = {
    "in/20260908_永安期货_商品日报.txt": ("2026-09-08", "永安期货", "商品日报", True), "20260908_永安期货.txt": ("2026-09-08", "永安期货", "永安期货", False), "永安期货_商品日报.txt": (None, "永安期货", "商品日报", False),
    "20261301_永安期货_日报.txt": (None, "永安期货", "日报", False), "随手命名.txt": (None, "随手命名", "随手命名", False), "_.txt": (None, "未知机构", "_", False), "2026-09-08_甲_早评_有色.txt": ("2026-09-08", "甲", "早评_有色", True),
}
#: net score -> market score, its name
SCORES = {-100.0: (0.0, "明显偏空"), -40.0: (30.0, "明显偏空"), -20.0: (40.0, "偏空"), 0.0: (50.0, "中性"), 20.0: (60.0, "偏多"), 25.0: (62.5, "偏多"), 33.3: (66.7, "偏多"), 40.0: (70.0, "明显偏多"), 100.0: (100.0, "明显偏多")}
#: bull, bear, neutral votes and the weight of bear ones -> net score
NETS = {(3, 1, 0, 1.3): 42.5, (0, 4, 0, 1.3): -100.0, (4, 0, 0, 1.3): 100.0, (2, 1, 1, 1.0): 25.0, (1, 1, 2, 1.0): 0.0, (0, 0, 3, 1.0): 0.0, (0, 0, 0, 1.0): 0.0, (4, 1, 0, 1.0): 60.0}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _rows(table: list[tuple], names: str, types: str) -> str:
    """A table of literals k, names."""
    body = ", ".join(f"({k}, {', '.join(map(_literal, row))})" for k, row in enumerate(table))
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names.split(), types.split(), strict=True))
    return f"(SELECT k, {casts} FROM (VALUES {body}) AS t(k, {', '.join(names.split())}))"


def _known(name: str, table: str, inputs: list[tuple], of: Callable[[dict[str, Column]], dict[str, Column]], names: str, types: str, results: list[tuple], keep: str = "true") -> None:
    """The query name: of(i0, i1, ...) of the input chosen by the id for every row of a table; and its SQL."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = spread(spark.read.parquet(f"{sf}/{table}.parquet").select("id"))
        k = (F.col("id") % len(inputs)).cast("int")
        given = {f"i{j}": F.get(F.array(*(F.lit(x[j]) for x in inputs)), k) for j in range(len(inputs[0]))}
        return rows.select("id", *(c.alias(n) for n, c in given.items())).select("id", *(c.alias(n) for n, c in of({n: F.col(n) for n in given}).items())).filter(keep)

    QUERIES[name] = query
    SQL[name] = f"SELECT s.id, {', '.join(f'x.{n}' for n in names.split())} FROM {table} s JOIN {_rows(results, names, types)} x ON x.k = s.id % {len(inputs)}"


_said = [(t, d) for d, texts in STANCE.items() for t in texts]
_known("stance_of_examples", "segment", [(t,) for t, _ in _said], lambda x: {"direction": stance.classify(x["i0"])["direction"] + F.lit(0.0)}, "direction", "DOUBLE", [(d,) for _, d in _said])
_known("evidence_of_examples", "segment", [(t,) for t in EVIDENCE], lambda x: {n: stance.classify(x["i0"])[n] for n in ("evidence", "matched")}, "evidence matched", "VARCHAR VARCHAR", list(EVIDENCE.values()))
_known("cascade_of_examples", "segment", list(CASCADE), lambda x: {n: stance.score_segment(x["i0"], x["i1"])[n] + F.lit(0.0) for n in ("direction", "confidence")}, "direction confidence", "DOUBLE DOUBLE", list(CASCADE.values()))
_known("products_of_examples", "report", [(t,) for t in PRODUCTS], lambda x: {"codes": F.array_join(products.match_products(x["i0"]), ","), "first": products.match_one(x["i0"])}, "codes first", "VARCHAR VARCHAR", [(c, c.split(",")[0] or None) for c in PRODUCTS.values()])
_known("names_of_examples", "report", [(t,) for t in NAMES], lambda x: {n: inbox.filename_meta(x["i0"])[n] for n in ("publish_time", "org_name", "title", "filename_ok")}, "publish_time org_name title filename_ok", "DATE VARCHAR VARCHAR BOOLEAN", list(NAMES.values()))
_known("scores_of_examples", "report", [(n,) for n in SCORES], lambda x: {"score": levels.market_score(x["i0"]), "label": levels.label(levels.market_score(x["i0"]))}, "score label", "DOUBLE VARCHAR", list(SCORES.values()))


def nets_of_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Net score of known counts; the weight is a parameter of the operator, so each has its own expression."""
    k = F.col("id") % len(NETS)
    net = F.coalesce(*(F.when(k == n, levels.net_score(*map(F.lit, votes[:3]), votes[3])) for n, votes in enumerate(NETS)))
    return spark.read.parquet(f"{sf}/report.parquet").select("id", net.alias("net"))


def blocks_of_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a known note for each report."""
    rows = spread(spark.read.parquet(f"{sf}/report.parquet").select("id"))
    notes = rows.select("id", F.get(F.array(*map(F.lit, NOTES)), (F.col("id") % len(NOTES)).cast("int")).alias("text"))
    return segmenting.segment_notes(notes, "id", "text").select("id", "seq", "product_code", "sector", "advice_text", "raw_text")


def pages_of_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Text of a known page for each report, by the function that reads files."""
    get = F.udf(text.html_text, "string", useArrow=True)
    return spread(spark.read.parquet(f"{sf}/report.parquet").select("id")).select("id", get(F.get(F.array(*map(F.lit, PAGES)), (F.col("id") % len(PAGES)).cast("int"))).alias("text"))


def files_of_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Status, reason and text of a known file for each report."""
    k = (F.col("id") % len(FILES)).cast("int")
    rows = spread(spark.read.parquet(f"{sf}/report.parquet").select("id"))
    files = rows.select(F.col("id").cast("string").alias("file_md5"), F.get(F.array(*(F.lit(f[0]) for f in FILES)), k).alias("path"), F.unhex(F.get(F.array(*(F.lit(f[1]) for f in FILES)), k)).alias("content"))
    return parsing.parse(files).select(F.col("file_md5").cast("long").alias("id"), "parse_status", "reason", "parsed_text")


QUERIES |= {f.__name__: f for f in (nets_of_examples, blocks_of_examples, pages_of_examples, files_of_examples)}
_blocks = [(n, k, *b) for n, found in enumerate(NOTES.values()) for k, b in enumerate(found)]
SQL |= {
    "nets_of_examples": f"SELECT s.id, x.net FROM report s JOIN {_rows([(n,) for n in NETS.values()], 'net', 'DOUBLE')} x ON x.k = s.id % {len(NETS)}",
    "blocks_of_examples": f"SELECT s.id, x.seq, x.product_code, x.sector, x.advice_text, x.raw_text FROM report s JOIN {_rows(_blocks, 'note seq product_code sector advice_text raw_text', 'INT INT VARCHAR VARCHAR VARCHAR VARCHAR')} x ON x.note = s.id % {len(NOTES)}",
    "pages_of_examples": f"SELECT s.id, x.text FROM report s JOIN {_rows([(t,) for t in PAGES.values()], 'text', 'VARCHAR')} x ON x.k = s.id % {len(PAGES)}",
    "files_of_examples": f"SELECT s.id, x.parse_status, x.reason, x.parsed_text FROM report s JOIN {_rows([f[2:] for f in FILES], 'parse_status reason parsed_text', 'VARCHAR VARCHAR VARCHAR')} x ON x.k = s.id % {len(FILES)}",
}
