"""Neighbours and repeats against all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bullgauge.llm import history, reports

CHARS = [bytes([a, b]).decode("gb2312") for a in range(0xB0, 0xD7) for b in range(0xA1, 0xFF)]


def variant(rng, text, share):
    c = list(text)
    for k in rng.sample(range(len(c)), int(len(c) * share)):
        c[k] = rng.choice(CHARS)
    return "".join(c)


def test_repeats_against_all_pairs(spark):
    rng = random.Random(11)
    start, docs = datetime(2026, 1, 1), []
    for i in range(260):
        t = start + timedelta(hours=i)
        if docs and rng.random() < 0.35:
            base = rng.choice(docs)[3] or ""
            text = base if rng.random() < 0.4 else variant(rng, base, rng.choice([0.01, 0.02, 0.04])) if base else ""
        else:
            text = "".join(rng.choice(CHARS) for _ in range(rng.randint(150, 700)))
        status = "ok" if i % 23 else "failed"
        md5 = None if i % 19 == 0 else (docs[-3][2] or "k") .upper() if i % 31 == 30 else f"m{i}"
        docs.append((i, t, md5, text if i % 37 else None, status, i % 4))
    df = spark.createDataFrame(docs, "id long, ingest_time timestamp_ntz, file_md5 string, parsed_text string, parse_status string, org_id long").withColumn("batch_no", F.lit("clash"))
    bounds = [(0, start, start + timedelta(hours=150))] + [(k, start + timedelta(hours=150 + 22 * (k - 1)), start + timedelta(hours=150 + 22 * k)) for k in range(1, 6)]
    batches = spark.createDataFrame(bounds, "batch_no int, opened_at timestamp_ntz, closed_at timestamp_ntz")
    got = {(r.a, r.b) for r in reports.repeats(spark, df, batches).collect()}
    label = {}
    for b in docs:
        links = []
        for a in docs[: b[0]]:
            same = a[2] and b[2] and a[2].lower() == b[2].lower()
            near = a[4] == b[4] == "ok" and a[3] and b[3] and history.similarity(a[3], b[3]) >= 0.6
            if same or near:
                links.append(label.get(a[0], a[0]))
        if links:
            label[b[0]] = min(links)
    want = {(a, b) for b, a in label.items() if 150 <= b < 260}
    assert len(want) > 20
    assert not got - want and len(want - got) <= 0.02 * len(want)


def test_copies_that_hold_most_rows(spark):
    rows = [(i, 0 if i < 300 else 1, None if i % 5 else "F", "同一份正文同一份正文同一份") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, batch_no int, f string, body string")
    keys = history.keyed(df, lambda b: b.column(3).to_pylist()).cache()
    h = history.History(spark, splits=2)
    first, second = h.add(keys.filter("batch_no = 0")), h.add(keys.filter("batch_no = 1"))
    assert first.count() == 0 and {(r.a, r.b) for r in second.collect()} == {(0, 300)}
    links = history.copies(keys).select("a", "b").unionByName(second.select("a", "b"))
    assert {r.a for r in history.first_of_all(spark, links).collect()} == {0}


def test_compaction_keeps_the_records(spark):
    rng = random.Random(4)
    base = "".join(rng.choice(CHARS) for _ in range(300))
    h = history.History(spark)
    for n in range(5):
        df = spark.createDataFrame([(n, n, None, base if n in (0, 4) else f"{n}" * 50)], "id long, batch_no int, f string, body string")
        pairs = h.add(history.keyed(df, lambda b: b.column(3).to_pylist()))
    assert len(h.runs) == 2 and {(r.a, r.b) for r in pairs.collect()} == {(0, 4)}


def test_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {(r.b, r.a) for r in history.first_of_all(spark, links).collect()} == {(k, 0) for k in range(1, 41)}


@pytest.mark.parametrize("body", ["", "abcd", "abcde", "aaaaaaaaaa"])
def test_short_bodies(body):
    h = history.shingles(body)
    assert h.size == len({body[i : i + 5] for i in range(len(body) - 4)})
    if h.size:
        assert history.near_keys(h).shape == (history.KEYS,)


def test_empty_batch(spark):
    df = spark.createDataFrame([], "id long, batch_no int, f string, body string")
    assert history.History(spark).add(history.keyed(df, lambda b: b.column(3).to_pylist())).count() == 0


def test_dense_editions(spark):
    """Editions of one note fill the buckets; every repeat that the keys bring into one bucket is found, with none lost behind nearer neighbours."""
    rng = random.Random(8)
    note = "".join(rng.choice(CHARS) for _ in range(400))
    bodies = [variant(rng, note, 0.05) for _ in range(500)]
    bodies += [variant(rng, rng.choice(bodies), 0.05) for _ in range(60)]
    start = datetime(2026, 1, 1)
    docs = [(i, start + timedelta(hours=i), f"m{i}", t, "ok", i % 25) for i, t in enumerate(bodies)]
    df = spark.createDataFrame(docs, "id long, ingest_time timestamp_ntz, file_md5 string, parsed_text string, parse_status string, org_id long")
    batches = spark.createDataFrame([(0, start, start + timedelta(hours=400)), (1, start + timedelta(hours=400), start + timedelta(hours=600))], "batch_no int, opened_at timestamp_ntz, closed_at timestamp_ntz")
    got = {(r.a, r.b) for r in reports.repeats(spark, df, batches).collect()}
    keys = [history.near_keys(history.shingles(t)).astype(">i8").view("u1").reshape(history.KEYS, 8) for t in bodies]
    label = {}
    for b in range(len(bodies)):
        links = []
        for a in range(b):
            same = (keys[a][:, : history.PREFIX] == keys[b][:, : history.PREFIX]).all(1)
            equal = (keys[a] == keys[b]).sum(1)
            if any(same[k] and equal[k] + equal[(k + 1) % history.KEYS] >= history.PREFIX + history.REST for k in range(history.KEYS)) and history.similarity(bodies[a], bodies[b]) >= history.SIMILAR:
                links.append(label.get(a, a))
        if links:
            label[b] = min(links)
    want = {(a, b) for b, a in label.items() if b >= 400}
    assert len(want) > 40 and got == want


@pytest.mark.parametrize("block", [1000, 37])
def test_tiles_of_a_crowd_against_all_pairs(spark, monkeypatch, block):
    """Tiles of any size link what all pairs link."""
    rng = random.Random(9)
    note = "".join(rng.choice(CHARS) for _ in range(200))
    bodies = [variant(rng, note, rng.choice([0.0, 0.02, 0.04, 0.06])) for _ in range(120)]
    rows = [(i, 0 if i < 60 else 1, None, t) for i, t in enumerate(bodies)]
    keys = history.keyed(spark.createDataFrame(rows, "id long, batch_no int, f string, body string"), lambda b: b.column(3).to_pylist()).cache()
    h = history.History(spark)
    for n in (0, 1):
        h.add(keys.filter(F.col("batch_no") == n))
    # the same bucket, cut into tiles here, as workers do not see a changed BLOCK
    monkeypatch.setattr(history, "BLOCK", block)
    got = pairs = 0
    records = [b for r in range(h.ranges) if r >= history.NEAR for b in history._crowds(h.runs, r)]
    frame = spark.createDataFrame([tuple(x.values()) for b in records for x in b.to_pylist()], history._CROWD)
    crowds = frame.filter("crowd IS NOT NULL")
    assert crowds.count()
    texts = spark.createDataFrame([(i, t) for i, _, _, t in rows], "id long, body string")
    links = history.alike_in_crowds(crowds, texts)
    label = {r.b: r.a for r in history.first_of_all(spark, links).collect()}
    direct = {(r.a, r.b) for r in links.collect()}
    assert all(history.similarity(bodies[a], bodies[b]) >= history.SIMILAR for a, b in direct)
    shared = {}
    for r in crowds.collect():
        shared.setdefault(r.crowd, {})[r.a] = (r.key.to_bytes(8, "big", signed=True), r.check.to_bytes(8, "big", signed=True))
    below = {}
    for a, b in direct:
        below.setdefault(b, set()).add(a)
    reach = {}
    for k in range(len(bodies)):
        reach[k] = set().union(*({a} | reach[a] for a in below.get(k, ())))
    for members in shared.values():
        for b in members:
            for a in members:
                same = sum(x == y for p, q in zip(members[a], members[b]) for x, y in zip(p, q))
                if a < b and same >= history.PREFIX + history.REST and history.similarity(bodies[a], bodies[b]) >= history.SIMILAR:
                    pairs += 1
                    got += a in reach[b]
    assert got == pairs > 100 and label


def test_equal_bodies_need_no_texts(spark):
    """Copies are links by their two hashes: a group that holds most rows sends no body anywhere."""
    rows = [(i, 0, f"f{i % 2}", "甲乙丙丁戊己" if i % 3 else None) for i in range(90)]
    keys = history.keyed(spark.createDataFrame(rows, "id long, batch_no int, f string, body string"), lambda b: b.column(3).to_pylist())
    got = {(r.a, r.b, r.key_no) for r in history.copies(keys).collect()}
    bodies = [i for i in range(90) if i % 3]
    assert got == {(i % 2, i, history.FILE) for i in range(2, 90)} | {(1, i, history.BODY) for i in bodies[1:]}
