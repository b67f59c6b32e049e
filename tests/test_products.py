import random

import pytest
from pyspark.sql import functions as F

from bullgauge import lexicon
from bullgauge.functions import products

CASES = {
    "氧化铝现货松动，沪铝维持高位": ["AO", "AL"], "螺纹钢领涨，随后沪铜跟涨，最后铁矿石补涨": ["RB", "CU", "I"], "炼焦煤库存回升": ["JM"], "热轧卷板": ["HC"], "pta 加工费走扩": ["TA"], "RB 主力合约": ["RB"],
    "CAPTAIN": [], "XPVCY": [], "A JAIC report": [], "RB2601 合约": [], "增量资金进场，银行间流动性宽松": [], "": [], "硅铁矿石": ["I"], "锰硅铁": ["SF"], "沪金属硅": ["SI"], "花生猪": ["LH"],
}


def test_match(spark):
    df = spark.createDataFrame([(t,) for t in [*CASES, None]], "t string")
    for r in df.select("t", products.match_products(F.col("t")).alias("m")).collect():
        assert r.m == CASES.get(r.t, [])
        assert list(products.find(r.t or "")) == r.m


def test_both_forms_agree_on_random_texts(spark):
    rng = random.Random(5)
    parts = [a for a, _ in lexicon.alias_index()] + ["。", " ", "x", "1", "的"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", products.match_products(F.col("t")).alias("m")).collect()
    assert all(list(products.find(r.t)) == r.m for r in got)


def test_sector(spark):
    df = spark.createDataFrame([("cu ",), ("沪铜",), ("??",), (None,)], "c string")
    assert [r[0] for r in df.select(products.sector_of(F.col("c"))).collect()] == ["有色", "有色", None, None]


@pytest.mark.parametrize("p", lexicon.PRODUCTS, ids=lambda p: p.code)
def test_every_name_finds_its_product(p):
    assert products.find(p.name) == (p.code,)
