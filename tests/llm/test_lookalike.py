"""The SQL operator against the plain function, on a small table."""

import pytest

from bullgauge.llm import lookalike as L

TEXTS = {
    "２０２６－０１": "2026－01", "报\u200b告": "报告", "ｔｅｓｔ．": "test.", "４．２％": "4.2%", "Ｂａ": "Ba", "\u2fbc\u2f8f": "高行", "\ufb01rm": "firm", "Se\u0301reno": "S\u00e9reno", "a\u2009b\u3000c": "a b c", "Тrаdіng РТА": "Trading PTA", "\U0001d40f\U0001d415\U0001d402主力": "PVC主力", "soft\u00adhyphen": "softhyphen",
}
SAME = ["中文，标点：（全角）！？", "Séreno Brännvik", "«цены на медь»", "β 系数与 Δ", "① ℃ № ½", "line\r\nend", "値上がり", "", None]


def test_fold():
    assert {t: L.fold(t) for t in TEXTS} == TEXTS
    assert all(t is None or L.fold(t) == t for t in SAME)


def test_operator(spark):
    rows = [(k, t) for k, t in enumerate([*TEXTS, *SAME, *TEXTS])]  # repeated rows too
    df = spark.createDataFrame(rows, "id long, text string")
    found = {r.id for r in L.found(df, ["id"], "text").collect()}
    assert found == {k for k, t in rows if t in TEXTS}
    new = {r.id: r.unified for r in L.unify(df, ["id"], "text").collect()}
    assert all(new[k] == TEXTS[t] for k, t in rows if t in TEXTS)


def test_equal_looking_texts_become_equal(spark):
    df = spark.createDataFrame([(1, "Se\u0301reno 4.2％"), (2, "S\u00e9reno\u00a04.2%"), (3, "S\u00e9re\u200bno 4.2%")], "id long, text string")
    new = {r.id: r.unified for r in L.unify(df, ["id"], "text").collect()}
    assert {new.get(k, "S\u00e9reno 4.2%") for k in (1, 2, 3)} == {"S\u00e9reno 4.2%"}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    assert L.found(df, ["id"], "text").count() == 0


WORDS = {
    "Сorrect报价Москва上涨": "Correct报价Москва上涨", "Cu-Рrice/Привет": "Cu-Price/Привет", "高价ΡΤΑ的": "高价PTA的", "warranty.\nΝο part of": "warranty.\nNo part of", "Brӓnnvіk was": "Brännvik was", "与PVС价差": "与PVC价差", "Valdériа矿区": "Valdéria矿区", "has yet tο price": "has yet to price",
}
FOREIGN = ["цены на сахар", "«сахар»", "Привет сахар тест", "Москва", "МОСКВА", "Ѕ", "ρ"]


def test_word_by_word(spark):
    """A word is mapped by its own letters and neighbours; real words of other languages stay, those of look-alikes only too."""
    assert {t: L.fold(t) for t in WORDS} == WORDS and [L.fold(t) for t in FOREIGN] == FOREIGN
    df = spark.createDataFrame(list(enumerate([*WORDS, *FOREIGN])), "id long, text string")
    assert {r.id for r in L.found(df, ["id"], "text").collect()} == set(range(len(WORDS)))
    new = {r.id: r.unified for r in L.unify(df, ["id"], "text").collect()}
    assert [new.get(k, t) for k, t in enumerate([*WORDS, *FOREIGN])] == [*WORDS.values(), *FOREIGN]
