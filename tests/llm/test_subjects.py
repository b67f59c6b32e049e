"""Held-out labels, and degenerate texts."""

import numpy as np
import pandas as pd

from bullgauge.llm import subjects


def test_held_out_labels():
    d = "/root/testdata/sf0.1"
    docs, labels, areas = (pd.read_parquet(f"{d}/{t}.parquet") for t in ("documents", "subject_label", "subject_area"))
    areas = areas.sort_values("subject")
    number = {s: k for k, s in enumerate(areas.subject)}
    docs = docs[docs.text.fillna("").str.strip() != ""]
    own = labels.groupby("doc_id").subject.agg(set)
    docs = docs[docs.doc_id.isin(own.index)]
    y = np.zeros((len(docs), len(number)))
    for k, i in enumerate(docs.doc_id):
        for s in own[i]:
            y[k, number[s]] = 1
    test = np.random.default_rng(0).random(len(docs)) < 0.3
    texts = docs.text.to_numpy()
    h = subjects.fit(list(texts[~test]), y[~test], [f"{a}\n{b}" for a, b in zip(areas.name_zh, areas.scope, strict=True)])
    doc, s, share = subjects.assign(subjects.Terms(list(texts[test])), h)
    got = np.zeros((test.sum(), len(number)))
    got[doc, s] = 1
    hit = (got * y[test]).sum()
    assert hit / got.sum() > 0.9 and hit / y[test].sum() > 0.9  # some labels are wrong
    assert (share >= subjects.MIN_SHARE - 1e-6).all()


def test_degenerate(spark):
    docs = spark.createDataFrame([(1, "沪铜库存去化，铜价上涨。"), (2, None), (3, ""), (4, "  \n"), (5, "!!! 123"), (6, "沪铜库存去化，铜价上涨。"), (7, "体育比赛，球队获胜。" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "metals"), (1, "metals"), (7, "sport"), (7, "nothing")], "doc_id long, subject string")
    areas = spark.createDataFrame([("metals", "有色", "copper"), ("sport", "体育", "matches")], "subject string, name_zh string, scope string")
    got = {(r.doc_id, r.subject) for r in subjects.subjects(spark, docs, labels, areas).collect()}
    assert {d for d, _ in got} <= {1, 6, 7} and (7, "sport") in got and ((1, "metals") in got) == ((6, "metals") in got)
    assert subjects.subjects(spark, docs.limit(0), labels, areas).count() == 0
