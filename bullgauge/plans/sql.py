"""The same queries in SQL (DuckDB dialect), written from their definitions."""

from __future__ import annotations

from bullgauge.operators.levels import half_table
from bullgauge.settings import UNKNOWN_ORG


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values) + "]"


def _negation(lexicon) -> str:
    return "|".join(sorted(lexicon.NEGATIONS, key=len, reverse=True))


def _factor(text: str, lexicon) -> str:
    has = lambda w: f"regexp_matches({text}, '(^|[^策战忽省方])略')" if w == "略" else f"contains({text}, '{w}')"
    return " * ".join(f"CASE WHEN {has(w)} THEN {f}::DOUBLE ELSE 1.0::DOUBLE END" for w, f in lexicon.INTENSITY.items())


def _stance(lexicon) -> str:
    """said(id, rule, direction, confidence, negated) of every advice: clauses, first rule of each, negation, intensity; the first clause with a direction, else the first, else the whole text."""
    # RE2 has no look-behind; what stands before a match decides nothing but where it begins
    plain = [r.pattern.replace("(?<!难)", "") for r in lexicon.RULES]
    first = " ".join(f"WHEN regexp_matches(c, '{p}') THEN {k}" for k, p in enumerate(plain, 1))
    match = " ".join(f"WHEN {k} THEN regexp_extract(c, '{'(?:^|[^难])(' + p + ')' if r.pattern != p else '(' + p + ')'}', 1)" for k, (p, r) in enumerate(zip(plain, lexicon.RULES, strict=True), 1))
    per = lambda f: f"{_list([f(r) for r in lexicon.RULES])}"
    sep = "，。；、：！？,;:.!?（）()【】\\[\\]“”\"''《》\\n\\t·—\\- 　"
    blank = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{85}]"
    return f"""WITH parts AS (
      SELECT id, i, unnest(cl) AS raw FROM (SELECT id, advice_text, list_filter(regexp_split_to_array(advice_text, '[，,；;。！？!?、\n\t]+'), lambda x: x <> '') AS cl0 FROM segment), LATERAL (SELECT unnest(range(len(cl0))) AS i, [cl0[i + 1]] AS cl)
      UNION ALL SELECT id, 1000000, advice_text FROM segment WHERE regexp_matches(advice_text, '[，,；;。！？!?、\n\t]')),
    ruled AS (SELECT *, CASE {first} END AS k FROM (SELECT id, i, lower(regexp_replace(raw, '{blank}', '', 'g')) AS c FROM parts)),
    found AS (SELECT *, strpos(c, m) AS pos FROM (SELECT *, CASE k {match} END AS m FROM ruled WHERE k IS NOT NULL)),
    win AS (SELECT *, regexp_extract(substr(c, greatest(1, pos - 6), least(pos - 1, 6)), '[^{sep}]*$') AS lft, {per(lambda r: r.direction)}[k]::DOUBLE AS d, {per(lambda r: r.confidence)}[k]::DOUBLE AS conf, {per(lambda r: int(r.group == "special" or r.direction == 0))}[k] = 1 AS pl FROM found),
    neg AS (SELECT *, NOT pl AND len(regexp_extract_all(lft, '{_negation(lexicon)}')) % 2 = 1 AS n, {_factor("(lft || m)", lexicon)} AS f FROM win),
    judged AS (SELECT id, i, CAST(k AS INT) AS rule, n AS negated,
      CASE WHEN n THEN -sign(d) * 0.5::DOUBLE WHEN NOT pl AND f <> 1 THEN sign(d) * round(least(2.0::DOUBLE, greatest(0.3::DOUBLE, abs(d) * f)), 2) ELSE d END AS direction,
      CASE WHEN n THEN 0.55::DOUBLE WHEN NOT pl AND f <> 1 THEN round(least(0.99::DOUBLE, greatest(0.05::DOUBLE, conf * (0.6::DOUBLE + 0.4::DOUBLE * f))), 2) ELSE conf END AS confidence FROM neg),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i = 1000000, direction = 0, i) AS rn FROM judged),
    said AS (SELECT g.id, b.rule, b.direction + 0.0::DOUBLE AS direction, b.confidence, b.negated FROM segment g LEFT JOIN best b ON b.id = g.id AND b.rn = 1)"""


def _products(lexicon) -> str:
    """Codes of every title: the aliases one after the other, the longest first, each hit filled up so that no later alias sees it."""
    aliases = ", ".join(f"({k}, '{a}', '{c}', {str(a.isascii()).lower()})" for k, (a, c) in enumerate(lexicon.alias_index()))
    last = len(lexicon.alias_index())
    edge = "'(^|[^0-9A-Za-z])' || a || '($|[^0-9A-Za-z])'"
    fill = "repeat(CASE WHEN word THEN 'Z' ELSE chr(1) END, length(a))"
    return f"""WITH RECURSIVE al(k, a, code, word) AS (VALUES {aliases}),
    step AS (
      SELECT id, 0 AS k, translate(coalesce(title, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS rest, 0 AS place, '' AS code FROM report
      UNION ALL
      SELECT id, k + 1, CASE WHEN pos = 0 THEN rest WHEN word THEN regexp_replace(regexp_replace(rest, {edge}, '\\1' || fill || '\\2', 'g'), {edge}, '\\1' || fill || '\\2', 'g') ELSE replace(rest, a, fill) END, pos, alias_code
      FROM (SELECT s.id, s.k, s.rest, al.a, al.word, al.code AS alias_code, {fill} AS fill,
              CASE WHEN NOT al.word THEN strpos(s.rest, al.a) WHEN regexp_matches(s.rest, {edge}) THEN length(regexp_extract(s.rest, '^(.*?(?:^|[^0-9A-Za-z]))' || al.a || '(?:$|[^0-9A-Za-z])', 1)) + 1 ELSE 0 END AS pos
            FROM step s JOIN al ON al.k = s.k)),
    firsts AS (SELECT id, code, min(place) AS place FROM step WHERE place > 0 GROUP BY ALL)
    SELECT r.id, coalesce(string_agg(f.code, ',' ORDER BY f.place, f.code), '') AS codes FROM report r LEFT JOIN firsts f ON f.id = r.id GROUP BY r.id"""


def build(lexicon) -> dict[str, str]:
    sectors = "CASE product_code " + " ".join(f"WHEN '{p.code}' THEN '{p.sector}'" for p in lexicon.PRODUCTS) + " END"
    sectors_any = "CASE upper(trim(product_code)) " + " ".join(f"WHEN '{p.code}' THEN '{p.sector}'" for p in lexicon.PRODUCTS) + " " + " ".join(f"WHEN '{p.name}' THEN '{p.sector}'" for p in lexicon.PRODUCTS if p.name != p.code) + " END"
    half = _list(half_table()) + "::DOUBLE[]"

    last = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY segment_id{v} ORDER BY id DESC) AS rn FROM score) WHERE rn = 1)"
    scored = f"""scored AS (
      SELECT sg.id AS segment_id, sg.report_id, sg.sector, sg.seq, nullif(trim(sg.product_code), '') AS product_code, o.name AS org_name, r.ingest_time,
             CAST(r.ingest_time AS DATE) AS trade_date, s.direction + 0.0::DOUBLE AS direction, s.confidence, s.model_version
      FROM segment sg JOIN {last.format(v=", model_version")} s ON s.segment_id = sg.id JOIN report r ON r.id = sg.report_id JOIN org o ON o.id = r.org_id)"""
    ballot = f"""{scored}, readable AS (SELECT * FROM scored WHERE coalesce(confidence, 0) > 0),
    votes AS (SELECT model_version, trade_date, org_name, product_code, coalesce(sector, {sectors}) AS sector, report_id, segment_id, direction, confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY model_version, org_name, product_code, trade_date ORDER BY ingest_time DESC, report_id DESC, segment_id DESC) AS rn FROM readable) WHERE rn = 1)"""

    def index(weight: str = "1.0") -> str:
        def level(name: str, key: str, where: str) -> str:
            return f"""SELECT trade_date, '{name}' AS level, {key} AS key, model_version, count(*) FILTER (direction > 0.25) AS b, count(*) FILTER (direction < -0.25) AS s, count(*) AS n, count(DISTINCT org_name) AS c
              FROM votes WHERE {where} GROUP BY ALL"""

        return f"""{ballot}, idx AS (
          SELECT trade_date, level, key, round_even(greatest(-100.0::DOUBLE, least(100.0::DOUBLE, (b - s * {weight}::DOUBLE) / n * 100)), 1) AS net_score, CAST(b AS BIGINT) AS bull_count, CAST(s AS BIGINT) AS bear_count, CAST(n - b - s AS BIGINT) AS neutral_count,
                 CAST(c AS BIGINT) AS coverage_count, model_version, 'netscore-v1' AS calc_version
          FROM ({level("product", "product_code", "product_code IS NOT NULL")} UNION ALL {level("sector", "sector", "product_code IS NOT NULL AND nullif(trim(sector), '') IS NOT NULL")} UNION ALL {level("market", "'MARKET'", "true")}))"""

    score = lambda x: f"({half})[CAST(round(({x} + 100) * 10) AS INT) + 1]"
    compared = f"""{index()}, days AS (SELECT model_version, trade_date, lag(trade_date) OVER (PARTITION BY model_version ORDER BY trade_date) AS p FROM (SELECT DISTINCT model_version, trade_date FROM idx)),
    cmp AS (SELECT i.*, b.trade_date AS prev_date, b.net_score AS prev_net, round_even(i.net_score - b.net_score, 1) AS delta, {score("i.net_score")} AS score, {score("b.net_score")} AS prev_score
      FROM idx i JOIN days d ON d.model_version = i.model_version AND d.trade_date = i.trade_date LEFT JOIN idx b ON b.model_version = i.model_version AND b.trade_date = d.p AND b.level = i.level AND b.key = i.key),
    cmp2 AS (SELECT *, round_even(score - prev_score, 1) AS delta_score FROM cmp)"""
    base = """base AS (SELECT model_version, trade_date, count(*) AS orgs, count(*) FILTER (u > d) AS bull_orgs, count(*) FILTER (u < d) AS bear_orgs, count(*) FILTER (u = d) AS tie_orgs, CAST(sum(n) AS BIGINT) AS blocks,
      round_even((count(*) FILTER (u > d) - count(*) FILTER (u < d)) * 100.0::DOUBLE / count(*), 1) AS net
      FROM (SELECT model_version, trade_date, org_name, count(*) FILTER (direction > 0) AS u, count(*) FILTER (direction < 0) AS d, count(*) AS n FROM readable GROUP BY ALL) GROUP BY ALL)"""
    counts = "net_score, bull_count, bear_count, neutral_count, coverage_count"
    stem = r"trim(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]*$', ''))"
    parts = f"list_filter(list_transform(string_split({stem}, '_'), lambda x: trim(x)), lambda x: x <> '')"
    compact = r"lower(regexp_replace(advice_text, '\s', '', 'g'))"
    rules = " ".join(f"WHEN regexp_matches(c, '{r.pattern.replace('(?<!难)', '')}') THEN {r.ord}" for r in lexicon.RULES)
    stance = _stance(lexicon)
    found = {
        "match_products": _products(lexicon),
        "classify_advice": f"{stance} SELECT id, rule, direction, confidence, negated FROM said",
        "method_stats": f"{stance} SELECT g.product_code, count(*) AS total, count(s.rule) AS hit, count(*) FILTER (s.direction > 0.25) AS bull, count(*) FILTER (s.direction < -0.25) AS bear FROM segment g JOIN said s ON s.id = g.id GROUP BY 1",
        "rule_hits": f"SELECT CAST(rule AS INT) AS rule, count(*) AS n FROM (SELECT CASE {rules} END AS rule FROM (SELECT {compact} AS c FROM segment)) GROUP BY 1",
        "intensity": f"SELECT id, {_factor('advice_text', lexicon)} AS factor FROM segment",
        "negation": f"SELECT id, CAST(len(regexp_extract_all(coalesce({compact}, ''), '{_negation(lexicon)}')) AS INT) AS negations FROM segment",
        "pooled_net": f"WITH {index()} SELECT model_version, trade_date, CAST(sum(bull_count) - sum(bear_count) AS DOUBLE) * 100 / CAST(sum(bull_count + bear_count + neutral_count) AS DOUBLE) AS net FROM idx WHERE level = 'product' GROUP BY ALL",
        "reports_with_org": "SELECT r.id, o.name AS org_name, r.title, CAST(r.ingest_time AS DATE) AS trade_date, r.parse_status FROM report r JOIN org o ON o.id = r.org_id",
        "pending_reports": "SELECT id, title, file_path FROM report WHERE parse_status = 'pending'",
        "unsegmented": "SELECT id, title FROM report r WHERE parse_status = 'ok' AND NOT EXISTS (SELECT 1 FROM segment s WHERE s.report_id = r.id)",
        "unscored": "SELECT id, report_id, seq FROM segment g WHERE NOT EXISTS (SELECT 1 FROM score s WHERE s.segment_id = g.id AND s.model_version = 'rule-v2')",
        "latest_score": f"SELECT segment_id, id, direction, confidence, model_version FROM {last.format(v='')}",
        "latest_score_by_version": f"SELECT segment_id, model_version, id, direction, confidence FROM {last.format(v=', model_version')}",
        "scored_segments": f"WITH {scored} SELECT segment_id, report_id, org_name, product_code, sector, trade_date, direction, confidence, model_version, seq FROM scored",
        "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("org", "report", "segment", "score")),
        "file_dedupe": "SELECT lower(file_md5) AS file_md5, min(id) AS id, count(*) AS copies FROM report WHERE file_md5 IS NOT NULL GROUP BY 1",
        "readable_votes": f"WITH {ballot} SELECT model_version, trade_date, count(*) AS n FROM readable GROUP BY ALL",
        "vote_dedupe": f"WITH {ballot} SELECT model_version, trade_date, org_name, product_code, sector, report_id, segment_id, direction, confidence FROM votes",
        "macro_votes": f"WITH {ballot} SELECT model_version, trade_date, org_name, segment_id, direction FROM votes WHERE product_code IS NULL",
        "vote_ranks": f"WITH {ballot} SELECT CAST(rn AS INT) AS rank, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY model_version, org_name, product_code, trade_date ORDER BY ingest_time DESC, report_id DESC, segment_id DESC) AS rn FROM readable) GROUP BY 1",
        "index_all_levels": f"WITH {index()} SELECT * FROM idx",
        **{f"index_{n}": f"WITH {index()} SELECT model_version, trade_date, key, {counts} FROM idx WHERE level = '{n}'" for n in ("market", "sector", "product")},
        "weighted_index": f"WITH {index('1.3')} SELECT model_version, trade_date, level, key, net_score FROM idx WHERE level <> 'product'",
        "market_score": f"WITH {index()} SELECT *, CASE WHEN score >= 70 THEN '明显偏多' WHEN score >= 60 THEN '偏多' WHEN score <= 30 THEN '明显偏空' WHEN score <= 40 THEN '偏空' ELSE '中性' END AS label FROM (SELECT model_version, trade_date, net_score, {score('net_score')} AS score FROM idx WHERE level = 'market')",
        "naive_baseline": f"WITH {ballot}, {base} SELECT * FROM base",
        "baseline_vs_index": f"WITH {index()}, {base} SELECT b.model_version, b.trade_date, b.net, i.net_score AS index_net, round_even(i.net_score - b.net, 1) AS diff FROM base b LEFT JOIN idx i ON i.level = 'market' AND i.model_version = b.model_version AND i.trade_date = b.trade_date",
        "org_hits": f"WITH {ballot} SELECT model_version, trade_date, org_name, count(product_code) AS hits FROM votes GROUP BY ALL",
        "day_counts": f"WITH {ballot} SELECT model_version, trade_date, count(*) AS opinions, count(product_code) AS product_opinions, count(*) FILTER (product_code IS NOT NULL AND confidence < 0.6) AS low_confidence, count(DISTINCT product_code) AS products, count(DISTINCT org_name) AS orgs FROM votes GROUP BY ALL",
        "low_confidence_queue": f"WITH {ballot} SELECT model_version, trade_date, org_name, product_code, segment_id, confidence FROM votes WHERE product_code IS NOT NULL AND confidence < 0.6",
        "version_coexistence": f'WITH {index()} SELECT model_version, calc_version, level, count(*) AS "rows", count(DISTINCT trade_date) AS days FROM idx GROUP BY ALL',
        "stance_matrix": f"""WITH {ballot}, cells AS (SELECT v.*, o.k, CASE WHEN direction >= 1.5 THEN '++' WHEN direction > 0.25 THEN '+' WHEN direction <= -1.5 THEN '--' WHEN direction < -0.25 THEN '-' ELSE '·' END AS sign
          FROM votes v LEFT JOIN (SELECT name, row_number() OVER (ORDER BY id) - 1 AS k FROM org) o ON o.name = v.org_name WHERE product_code IS NOT NULL)
          SELECT model_version, trade_date, product_code, {", ".join(f"coalesce(max(sign) FILTER (k = {k}), '') AS c{k}" for k in range(25))} FROM cells GROUP BY ALL""",
        "index_dates": f"WITH {compared} SELECT model_version, trade_date, p AS prev_index_date FROM days",
        "latest_date": f"WITH {index()} SELECT model_version, max(trade_date) AS last, min(trade_date) AS first FROM idx GROUP BY 1",
        "compare_previous": f"WITH {compared} SELECT model_version, trade_date, level, key, net_score, prev_date, prev_net, delta, delta_score FROM cmp2",
        "top_movers": f"WITH {compared} SELECT model_version, trade_date, rank, key, delta FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model_version, trade_date ORDER BY abs(delta) DESC, key) AS INT) AS rank FROM cmp WHERE level = 'product' AND delta IS NOT NULL AND delta <> 0) WHERE rank <= 3",
        "most_divergent": f"WITH {index()} SELECT model_version, trade_date, rank, key, bull_count, bear_count FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model_version, trade_date ORDER BY least(bull_count, bear_count) DESC, abs(net_score), key) AS INT) AS rank FROM idx WHERE level = 'product' AND bull_count > 0 AND bear_count > 0) WHERE rank <= 3",
        "alert_days": f"""WITH {compared} SELECT * FROM (SELECT model_version, trade_date, score, delta_score, concat_ws(',', CASE WHEN prev_score IS NULL AND score >= 60 THEN 'bull' END, CASE WHEN prev_score IS NULL AND score <= 40 THEN 'bear' END,
          CASE WHEN score >= 60 AND prev_score < 60 THEN 'cross_up' END, CASE WHEN score <= 40 AND prev_score > 40 THEN 'cross_down' END, CASE WHEN abs(delta_score) >= 15 THEN 'jump' END) AS reasons FROM cmp2 WHERE level = 'market') WHERE reasons <> ''""",
        "index_series": f"WITH {index()} SELECT trade_date, net_score, coverage_count FROM idx WHERE model_version = 'rule-v1' AND level = 'market' AND trade_date <= DATE '2026-06-30' ORDER BY trade_date DESC LIMIT 30",
        "normalize_text": r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(parsed_text, '\r\n?', chr(10), 'g'), '　' || chr(160), '  '), '[ \t\f\x0b]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM report""",
        "garbled_ratio": r"SELECT id, CASE WHEN coalesce(length(parsed_text), 0) = 0 THEN 0.0::DOUBLE ELSE round(len(regexp_extract_all(parsed_text, '[\x{FFFD}\x00-\x08\x0B-\x1F]'))::DOUBLE / length(parsed_text), 6) END AS ratio FROM report",
        "sentence_counts": r"SELECT id, CAST(len(list_filter(list_transform(regexp_extract_all(raw_text, '[^。！？；!?;\n]*[。！？；!?;]|[^。！？；!?;\n]+'), lambda x: regexp_replace(x, '[\s\x{A0}\x{3000}\x{2000}-\x{200A}\x{202F}\x{205F}\x{85}]', '', 'g')), lambda x: x <> '')) AS INT) AS sentences FROM segment",
        "md5_keys": "SELECT id, md5(parsed_text) AS md5 FROM report",
        "filename_meta": f"""SELECT id, d AS publish_time, coalesce(rest[1], '{UNKNOWN_ORG}') AS org_name, CASE WHEN len(rest) > 1 THEN array_to_string(rest[2:], '_') WHEN len(rest) = 1 THEN rest[1] ELSE stem END AS title, d IS NOT NULL AND len(rest) >= 2 AS filename_ok
          FROM (SELECT id, stem, d, CASE WHEN d IS NOT NULL OR regexp_matches(parts[1], '^\\d{{4}}[-./]?\\d{{1,2}}[-./]?\\d{{1,2}}$') THEN parts[2:] ELSE parts END AS rest
          FROM (SELECT *, CAST(try_strptime(parts[1], '%Y%m%d') AS DATE) AS d FROM (SELECT id, {stem} AS stem, {parts} AS parts FROM report)))""",
        "ingest_clock": "SELECT id, CAST(publish_time AS TIMESTAMP) + CASE WHEN regexp_matches(title, '午间|午评|午后|盘中|更新|日中') THEN INTERVAL '12:30:00' ELSE INTERVAL '6:30:00' END AS clock FROM report WHERE publish_time IS NOT NULL",
        "sector_of": f"SELECT id, {sectors_any} AS sector FROM segment",
        "first_rule": f"SELECT id, CAST(CASE {rules} END AS INT) AS rule FROM (SELECT id, {compact} AS c FROM segment)",
    }
    return found | {"stance_matrix_all": found["stance_matrix"]}
