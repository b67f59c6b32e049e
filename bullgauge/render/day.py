"""One day of the index as text and HTML. Only the rows of that day come to the driver: products x houses, both small fixed sets."""

from __future__ import annotations

import html
import unicodedata
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bullgauge import lexicon
from bullgauge.operators import levels, trends
from bullgauge.settings import DEFAULT, Settings


@dataclass
class Day:
    day: date
    market: dict[str, Any] | None
    sectors: list[dict]
    products: list[dict]
    votes: dict[tuple[str, str], dict]
    orgs: list[tuple[str, int]]
    series: list[dict]
    baseline: dict | None
    movers: list[dict]
    split: list[dict]
    reasons: str
    counts: dict
    versions: tuple[str, str] = field(default=("", ""))
    turned: int | None = None  # houses more (or less) that are bullish on the product that moved most


def last_day(index: DataFrame, day: str | None = None) -> str | None:
    """The given day or the last of the index."""
    if day:
        return day
    d = index.agg(F.max("trade_date").alias("d")).first()["d"]
    return d.isoformat() if d else None


def load_day(index: DataFrame, readable: DataFrame, votes: DataFrame, day: str, s: Settings = DEFAULT) -> Day:
    """Everything that the outputs show, taken once, so the same number appears in all."""
    on = F.col("trade_date") == F.lit(day).cast("date")
    until = index.filter(F.col("trade_date") <= F.lit(day).cast("date"))
    rows = [r.asDict() for r in trends.compare_previous(until).filter(on).join(index.filter(on).select("level", "key", "bull_count", "bear_count", "neutral_count"), ["level", "key"]).collect()]
    ballot = [r.asDict() for r in votes.filter(on).select("org_name", "product_code", "direction", "confidence", "evidence", "title", "publish_time", "ingest_time").collect()]
    hits: dict[str, int] = {}
    for v in ballot:
        hits[v["org_name"]] = hits.get(v["org_name"], 0) + (v["product_code"] is not None)
    market = next((r for r in rows if r["level"] == "market"), None)
    base = levels.baseline(readable.filter(on)).first()
    sector = lambda k: lexicon.BY_CODE[k].sector if k in lexicon.BY_CODE else None
    why = trends.alerts(until, s).filter(on).first()
    movers = [r.asDict() for r in trends.top_movers(until, 1).filter(on).collect()]
    return Day(
        date.fromisoformat(day), market,
        sorted((r for r in rows if r["level"] == "sector"), key=lambda r: (lexicon.sector_rank(r["key"]), r["key"])),
        sorted((r for r in rows if r["level"] == "product"), key=lambda r: (lexicon.sector_rank(sector(r["key"])), -r["net_score"], r["key"])),
        {(v["org_name"], v["product_code"]): v for v in ballot if v["product_code"]},
        sorted(hits.items(), key=lambda x: (-x[1], x[0])),
        [r.asDict() for r in trends.index_series(until, "market", "MARKET", 60).collect()],
        base.asDict() if base else None,
        movers,
        [r.asDict() for r in trends.most_divergent(until, 1).filter(on).collect()],
        why["reasons"] if why else "",
        {"opinions": len(ballot), "low": sum(v["product_code"] is not None and (v["confidence"] or 0) < s.low_confidence for v in ballot)},
        (rows[0]["model_version"], rows[0]["calc_version"]) if rows else ("", ""),
        _turned(until, rows, movers[0]["key"]) if movers else None,
    )


def _turned(until: DataFrame, rows: list[dict], key: str) -> int:
    """Bullish houses on a product against the index date before."""
    now = next(r for r in rows if r["level"] == "product" and r["key"] == key)
    before = until.filter((F.col("level") == "product") & (F.col("key") == key) & (F.col("trade_date") == F.lit(now["prev_date"]))).first()
    return now["bull_count"] - before["bull_count"]


def pooled(d: Day) -> float | None:
    """The net of all product votes: shown where a day has no market row."""
    votes = [sum(r[c] for r in d.products) for c in ("bull_count", "bear_count", "neutral_count")]
    return (votes[0] - votes[1]) / sum(votes) * 100 if sum(votes) else None


# ------------------------------------------------------------------ text
def width(text: str) -> int:
    """Columns on a terminal."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def pad(text: str, size: int, left: bool = False) -> str:
    blank = " " * max(0, size - width(text))
    return blank + text if left else text + blank


def signed(x: float | None, places: int = 1) -> str:
    return "NA" if x is None else f"{x:+.{places}f}"


def name(code: str) -> str:
    return lexicon.BY_CODE[code].name if code in lexicon.BY_CODE else code


def mark(d: float, s: Settings = DEFAULT) -> str:
    for sign, hit in (("++", d >= s.strong_cutoff), ("+", d > s.bull_cutoff), ("--", d <= -s.strong_cutoff), ("-", d < s.bear_cutoff)):
        if hit:
            return sign
    return "·"


def level_name(score: float) -> str:
    return next(n for n, hit in (("明显偏多", score >= 70), ("偏多", score >= 60), ("明显偏空", score <= 30), ("偏空", score <= 40), ("中性", True)) if hit)


_WHY = {"bull": "首日即位于偏多区", "bear": "首日即位于偏空区", "cross_up": "上破 60 进入偏多区", "cross_down": "下破 40 进入偏空区", "jump": "单日变化超过 15 分"}


def since(before: date | None, day: date) -> str:
    if before is None:
        return "上期"
    return "昨日" if (day - before).days == 1 else before.strftime("%m-%d")


def push_message(d: Day) -> str:
    if not d.market and (net := pooled(d)) is not None:
        return f"📊 {d.day} 无大盘汇总，按 {len(d.products)} 个品种合并：净得分 {signed(net)}"
    if not d.market:
        return f"（{d.day} 没有聚合结果：当日无覆盖，不产出数字）"
    m, out = d.market, []
    if d.reasons:
        out += ["⚠️ 重点提醒｜" + "；".join(_WHY[r] for r in d.reasons.split(",")), ""]
    change = f"较{since(m['prev_date'], d.day)} {signed(m['delta_score'])}" if m["delta_score"] is not None else "首日无环比"
    out += [f"📊 大盘情绪 {m['score']:.1f} 分（{level_name(m['score'])}）｜{change}｜覆盖 {m['coverage_count']} 家机构 / {d.counts['opinions']} 个观点", ""]
    if d.sectors:
        out += ["板块  " + "  ".join(f"{r['key']} {signed(r['net_score'], 0)}" for r in d.sectors), ""]
    if d.movers:
        r = d.movers[0]
        note = "家数未变" if not d.turned else f"{abs(d.turned)} 家{'转多' if d.turned > 0 else '转空'}"
        out.append(f"变化最大  {name(r['key'])} {signed(r['prev_net'], 0)} → {signed(r['net_score'], 0)}（{note}）")
    elif d.products:
        r = max(d.products, key=lambda r: (r["net_score"], r["key"]))
        out.append(f"最看多    {name(r['key'])} {signed(r['net_score'], 0)}（{r['bull_count']} 家看多）")
    out.append(f"分歧最大  {name(d.split[0]['key'])}（{d.split[0]['bull_count']} 家看多 / {d.split[0]['bear_count']} 家看空）" if d.split else "分歧最大  无")
    if not d.baseline:
        out.append("对照  NA（当日没有可读观点）")
    else:
        b = d.baseline
        out.append(f"对照（一家一票只数家数 {b['bull_orgs']}/{b['bear_orgs']}/{b['tie_orgs']}）{signed(b['net'])}")
    out.append(f"口径 {d.versions[1]}｜打分 {d.versions[0]}｜多空中 {m['bull_count']}/{m['bear_count']}/{m['neutral_count']}（{len(d.products)} 个品种有覆盖，其余记 NA）")
    return "\n".join(out)


def matrix_text(d: Day, s: Settings = DEFAULT) -> str:
    """Products by houses; blank is no coverage, not neutral."""
    if not d.products or not d.orgs:
        return "（当日没有品种级覆盖）"
    orgs, rows = [o for o, _ in d.orgs][: s.max_matrix_orgs], d.products[: s.max_matrix_rows]
    out = [pad("品种", 12) + pad("净得分", 8, True) + "  " + pad("多/空/中", 10) + "".join(pad(o[:4], 10) for o in orgs)]
    last = None
    for r in rows:
        sector = lexicon.BY_CODE[r["key"]].sector if r["key"] in lexicon.BY_CODE else "其他"
        if sector != last:
            out.append(f"【{sector}】")
            last = sector
        cells = (mark(v["direction"], s) if (v := d.votes.get((o, r["key"]))) else "" for o in orgs)
        out.append(pad(name(r["key"]), 12) + pad(signed(r["net_score"]), 8, True) + "  " + pad(f"{r['bull_count']}/{r['bear_count']}/{r['neutral_count']}", 10) + "".join(pad(c, 10) for c in cells))
    out.append("图例  ++ 强烈看多  + 看多  · 中性  - 看空  -- 强烈看空  空白 = 未覆盖")
    more = [f"另有 {len(all_) - n} {what}未列出" for all_, n, what in ((d.orgs, len(orgs), "家机构"), (d.products, len(rows), "个品种")) if len(all_) > n]
    return "\n".join(out + more)


def two_sided(net: float, half: int = 20) -> str:
    """A bar to the left of the middle for bears, to the right for bulls."""
    n = round(abs(net) / 100 * half)
    return (" " * (half - n) + "█" * n if net < 0 else " " * half) + "│" + ("█" * n if net > 0 else "")


def painted(text: str, net: float, color: bool) -> str:
    """Red for bulls, green for bears."""
    return f"\033[{31 if net > 0 else 32}m{text}\033[0m" if color and net else text


def terminal(d: Day, s: Settings = DEFAULT, color: bool = False) -> str:
    if not d.market:
        return push_message(d)
    score = d.market["score"]
    filled = round(score / 2)
    gauge = "█" * filled + "░" * (50 - filled)
    bars = [pad(r["key"], 10) + pad(signed(r["net_score"]), 8, True) + "  " + painted(two_sided(r["net_score"]), r["net_score"], color) for r in d.sectors]
    return "\n".join([f"{d.day}  大盘 {score:.1f}  {level_name(score)}", "0 " + painted(gauge, score - 50, color) + " 100", "", *bars, "", matrix_text(d, s), "", push_message(d)])


# ------------------------------------------------------------------ HTML
_CSS = "body{font:14px sans-serif;margin:2em auto;max-width:1100px}table{border-collapse:collapse}td,th{padding:3px 8px;border-bottom:1px solid #ddd;text-align:center}.u{color:#b02020}.d{color:#207040}.low{opacity:.5}"


def _chart(d: Day) -> str:
    points = [(r["net_score"] + 100) / 2 for r in d.series]
    if not points:
        return ""
    step = 600 / max(1, len(points) - 1)
    line = " ".join(f"{k * step:.1f},{200 - 2 * y:.1f}" for k, y in enumerate(points))
    return f'<svg viewBox="0 0 600 200" width="600" height="200"><rect y="0" width="600" height="80" fill="#fdeaea"/><rect y="120" width="600" height="80" fill="#e8f5ec"/><polyline fill="none" stroke="#333" points="{line}"/></svg>'


def html_page(d: Day, s: Settings = DEFAULT) -> str:
    """A page without scripts or links to other files."""
    e = html.escape
    head = f"<!doctype html><html lang=zh><meta charset=utf-8><title>{d.day}</title><style>{_CSS}</style><h1>{d.day}</h1>"
    if not d.market:
        return head + f"<p>{e(push_message(d))}</p></html>"
    tone = lambda x: "u" if x > 0 else "d" if x < 0 else ""
    sectors = "".join(f"<tr><td>{e(r['key'])}<td class={tone(r['net_score']) or 'n'}>{signed(r['net_score'])}" for r in d.sectors)
    orgs = [o for o, _ in d.orgs]

    def cell(o: str, code: str) -> str:
        v = d.votes.get((o, code))
        if not v:
            return "<td>"
        tip = f"{(v['evidence'] or '')[:220]}｜{v['title'] or ''}｜{v['confidence']:.2f}｜{'/'.join(d.versions)}｜{v.get('publish_time') or 'NA'} → {v.get('ingest_time') or 'NA'}"
        low = " low" if v["confidence"] < s.low_confidence else ""
        return f'<td class="{tone(v["direction"])}{low}" title="{e(tip, quote=True)}">{mark(v["direction"], s)}'

    body = "".join(f"<tr><th>{e(name(r['key']))}<td>{signed(r['net_score'])}" + "".join(cell(o, r["key"]) for o in orgs) for r in d.products)
    base = "NA" if not d.baseline else signed(d.baseline["net"])
    facts = e(f"{d.market['coverage_count']} 家机构 · {d.counts['opinions']} 个观点 · {len(d.products)} 个品种 · 低置信 {d.counts['low']} · 对照 {base}")
    foot = e(f"口径 {d.versions[1]}，打分 {d.versions[0]}，看空权重 {s.bear_weight:g}；空白为未覆盖，不是中性")
    return (
        head + f"<p><b>{d.market['score']:.1f}</b> {level_name(d.market['score'])} {signed(d.market['delta_score'])}</p><p>{facts}</p>" + _chart(d)
        + f"<table>{sectors}</table><table><tr><th><th>" + "".join(f"<th>{e(o)}" for o in orgs) + body + f"</table><pre>{e(push_message(d))}</pre><footer>{foot}</footer></html>"
    )
