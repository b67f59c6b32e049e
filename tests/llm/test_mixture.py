import numpy as np
import pytest
from pyspark.sql import functions as F

from bullgauge.llm import mixture


def test_knapsack_against_all_sums():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 40), rng.integers(1, 6), replace=False))
        counts = rng.integers(0, 4, lengths.size)
        budget = int(rng.integers(0, 120))
        sums = {0}
        for length, c in zip(lengths, counts, strict=True):
            sums |= {s + k * int(length) for s in sums for k in range(c + 1)}
        take = mixture.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_fit_hits_the_budget():
    rng = np.random.default_rng(1)
    lengths, counts = np.arange(5, 400), rng.integers(0, 30, 395)
    for budget in (0, 17, 5_000, 123_457, int((lengths * counts).sum())):
        take = mixture.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert 0 <= budget - (take * lengths).sum() <= 5


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    docs = [(i, ["big", "mid", "small", None, "unlisted"][0 if i % 3 == 0 else i % 5], int(rng.integers(0, 90))) for i in range(3000)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_ids long").withColumn("target_share", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.35, 3), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    return docs, sized.drop("target_share"), targets


def test_shares(spark, tables):
    docs, sized, targets = tables
    mixed = mixture.mix(sized, targets, "doc_id").cache()
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.n_ids > 0 for r in rows)
    by = {r.source: r for r in mixture.shares(mixed, targets).collect()}
    for s, want, most in (("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.35, 3)):
        assert abs(by[s].share - want / 0.95) < 1e-3 and by[s].most_copies <= most
    assert by["none"].share == 0.0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixture.mix(sized, targets, "doc_id").collect()))
    other = mixture.mix(sized, targets, "doc_id", seed=7)
    assert {r.doc_id for r in other.collect()} != {r.doc_id for r in rows}


def test_larger_total_gives_all(spark, tables):
    docs, sized, targets = tables
    rows = mixture.mix(sized, targets, "doc_id", total=10**9).collect()
    most = {"big": 1, "mid": 2, "small": 3}
    assert len(rows) == sum(s in most and n > 0 for _, s, n in docs) and all(r.copies == most[r.source] for r in rows)


def test_empty(spark, tables):
    _, sized, targets = tables
    assert mixture.mix(sized.limit(0), targets, "doc_id").count() == 0


def test_knapsack_against_all_sums():
    import numpy as np

    from bullgauge.llm import mixture

    rng = np.random.default_rng(1)
    for _ in range(150):
        lengths = np.unique(rng.integers(2, 40, 5))
        counts, budget = rng.integers(1, 4, lengths.size), int(rng.integers(1, 100))
        take = mixture.knapsack(lengths, counts, budget)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {x + n * j for x in sums for j in range(c + 1) if x + n * j <= budget}
        assert (take * lengths).sum() == max(sums) and (take <= counts).all() and (take >= 0).all()
