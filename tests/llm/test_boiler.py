"""Repeated lines against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bullgauge.llm import boiler, repair


def test_containers():
    rng = np.random.default_rng(1)
    for a in (np.zeros(0, np.int64), np.array([0, 65_535]), np.arange(60_000), np.unique(rng.integers(0, 65_536, 30_000)), np.arange(0, 65_536, 2)):
        assert (boiler.unpack(boiler.pack(a)) == a).all()
        b = np.array([1, 2, 70])
        assert (boiler.unpack(boiler.union(boiler.pack(a), boiler.pack(b))) == np.union1d(a, b)).all()


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"声明 {k} 号：本材料仅供参考" for k in range(6)] + ["**加粗** 的声明", "", "   ", "页 {n}"]
    docs = []
    for i in range(300):
        org = None if i % 40 == 0 else 1 if i % 3 else rng.choice([2, 3])
        text = None if i % 50 == 7 else "\n".join([f"内容{chr(0x4E00 + rng.randint(0, 900))}{i % 97}甲" for _ in range(3)] + [rng.choice(pool).format(n=rng.randint(1, 99)) for _ in range(4)])
        docs.append((i * 70_000 % 1_000_003, org, text))
    df = spark.createDataFrame(docs, "id long, org_id long, parsed_text string").withColumn("parse_status", F.lit("ok")).withColumn("line", F.lit("clash"))
    found = boiler.report_lines(spark, df)
    lines = boiler.repeated(found, boiler.sources(df))
    got = {(r.doc, r.line_no) for r in boiler.places(found, lines).collect()}
    n, count, at = Counter(o for _, o, _ in docs if o), Counter(), {}
    for d, o, t in docs:
        if o and t:
            forms = [repair.line_form(x) for x in repair.comparable(t).split("\n")]
            for f in set(filter(None, forms)):
                count[o, f] += 1
            at.update({(d, k): (o, f) for k, f in enumerate(forms) if f})
    want = {p for p, (o, f) in at.items() if count[o, f] >= max(5, 0.06 * n[o])}
    assert got == want and want
    clean = {r.doc: r.text for r in boiler.without(df, "id", "parsed_text", boiler.places(found, lines)).collect()}
    for d, _, t in docs:
        assert clean[d] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in want))


def test_empty(spark):
    df = spark.createDataFrame([], "id long, org_id long, parsed_text string, parse_status string")
    found = boiler.report_lines(spark, df)
    assert boiler.places(found, boiler.repeated(found, boiler.sources(df))).count() == 0


def test_bitmaps_decide(spark):
    """Variants of a line are one line, over buckets and with runs; a document that has the line twice counts once; without its bitmap a line has no places."""
    docs = [(k, 1, "**声明** 甲" if k % 2 else "声明 甲\n声明 甲") for k in range(65_530, 65_542)] + [(k, 1, f"正文{chr(0x4E00 + k)}") for k in range(100)]
    df = spark.createDataFrame(docs, "id long, org_id long, parsed_text string").withColumn("parse_status", F.lit("ok"))
    found = boiler.report_lines(spark, df)
    lines = boiler.repeated(found, boiler.sources(df))
    rows = lines.collect()
    assert {(r.bucket, len(boiler.unpack(bytes(r.bitmap)))) for r in rows} == {(0, 6), (1, 6)} and {(r.docs, r.variants) for r in rows} == {(12, 2)}
    assert boiler.places(found, lines).count() == 18
    assert {r.doc for r in boiler.places(found, lines.filter("bucket = 1")).collect()} == set(range(65_536, 65_542))
    emptied = lines.withColumn("bitmap", F.lit(boiler.pack(np.array([60_000]))))
    assert boiler.places(found, emptied).count() == 0


def test_containers_of_lists_are_the_same(spark):
    rng = random.Random(5)
    rows = [(k, k % 3 or None, [rng.randint(0, 9) for _ in range(rng.randint(0, 6))]) for k in range(200)] + [(900, 1, None)]
    df = spark.createDataFrame(rows, "doc long, source long, lines array<long>")
    flat = spark.createDataFrame([(d, s, x, x) for d, s, xs in rows if s and xs for x in xs if x], "doc long, source long, line long, variant long")
    n = spark.createDataFrame([(1, 70), (2, 60)], "source long, n long")
    show = lambda t: {(r.source, r.line, r.bucket, bytes(r.bitmap), r.docs) for r in t.collect()}
    assert show(boiler.often(boiler.partial_of_lists(df), n)) == show(boiler.repeated(flat, n)) != set()
