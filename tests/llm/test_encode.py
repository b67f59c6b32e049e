"""Ids against the public library, and back."""

import random

import pytest
from tokenizers import Tokenizer

from bullgauge.llm import encode

BITS = ["a", "aa", "ab", " ", "  ", "\n", "\t", "\x1c", "\x85", "1", "²", "é", "中", "国", "期货", "<|endoftext|>", "'s", "'ll", "the", "ing", "​", "😀", "ſ", "!", "...", "----", "　", "\xa0", "x" * 300]


@pytest.fixture(scope="module")
def encoder():
    return encode.encoder(encode.TOKENIZER)


def test_like_the_library(encoder):
    rng = random.Random(2)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x4E00, 0x9FA5), rng.randint(1, 0x2FFF)])) for _ in range(40)) for _ in range(400)]
    t = Tokenizer.from_file(encode.TOKENIZER)
    t.encode_special_tokens = True
    ids, at = encoder.encode(texts)
    for k, (text, want) in enumerate(zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True)):
        got = ids[at[k] : at[k + 1]].tolist()
        assert got == want.ids
        assert encoder.decode(got) == text
    assert encoder.sizes(texts).tolist() == [int(at[k + 1] - at[k]) for k in range(len(texts))]


def test_table(spark):
    df = spark.createDataFrame([(1, "沪铜 up", "x"), (2, "", "x"), (3, None, "x"), (4, "沪铜 up", "x"), (5, "长" * 50_000, "x")], "doc_id long, text string, ids string")
    got = {r.key: r.ids for r in encode.ids(spark, df, "doc_id", "text").collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] and len(got[5]) >= 50_000
    assert encode.ids(spark, df.limit(0), "doc_id", "text").count() == 0


def test_long_words_and_a_table_begun_anew(monkeypatch):
    import json

    from bullgauge.llm import encode

    e = encode.Encoder(json.load(open(encode.TOKENIZER))["model"])
    texts = ["沪铜" * 5000, "x" * 70_000, "Lorem" * 3000 + " ipsum", "库存 去化"]
    first = [x.tolist() for x in e.encode(texts)]
    monkeypatch.setattr(encode, "MOST_STATES", 1)
    assert [x.tolist() for x in e.encode(texts)] == first
    at = first[1]
    assert [e.decode(first[0][a:b]) for a, b in zip(at, at[1:])] == texts
