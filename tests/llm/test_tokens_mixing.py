import os
import random

import numpy as np
import pytest

from threadloom.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def ranks():
    with open(tokens.TOKENIZER, "rb") as f:
        return tokens.read_ranks(f.read())


@pytest.fixture(scope="module")
def known(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "Hello world's  test\n\n\tx", "naïve — 测试 🚀👩‍💻", "<|endoftext|>", "a" * 5000, "x_y" * 3000, "\u0000�​", "é" * 400]


def test_ids(spark, known):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got == {k: known.encode_ordinary(t or "") for k, t in enumerate(TEXTS)}
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.count(df).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.limit(0)).count() == 0


def test_short_and_long_words_merge_alike(ranks):
    rng = random.Random(2)
    for _ in range(200):
        word = bytes(rng.choice(b"abcdeee \xc3\xa9thing") for _ in range(rng.randint(1, 300)))
        assert tokens.merge_short(word, ranks) == tokens.merge_long(word, ranks)


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 2000, 500).astype(float)
    out = mixing.flight(p, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum())
    assert (out * size).sum() == pytest.approx((p * size).sum())
    assert set(mixing.land(out, size)) <= {0.0, 1.0}
    assert mixing.flight(np.array([]), np.array([]), rng).size == 0
    same = mixing.flight(np.full(9, 0.5), np.full(9, 7.0), rng)
    assert same.sum() == pytest.approx(4.5)


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["big"] * 8 + ["small", "other"]), "word " * rng.randint(1, 60)) for k in range(600)] + [(1000, None, "x"), (1001, "big", None), (1002, "big", ""), (1003, "unlisted", "x y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 5.0, 1), ("small", 3.0, 4), ("absent", 2.0, 3)], "source string, weight double, max_repeat int")
    mixed, report = mixing.mix(docs, targets, block=50)
    made = {r["source"]: r for r in report.collect()}
    assert set(made) == {"big", "small", "absent"}
    assert made["absent"]["mixed_tokens"] == 0
    assert made["big"]["share"] == pytest.approx(5 / 8, abs=0.01)
    assert made["small"]["share"] == pytest.approx(3 / 8, abs=0.01)
    assert made["small"]["most_copies"] <= 4
    got = mixed.collect()
    assert {r["source"] for r in got} == {"big", "small"}
    assert len({r["doc_id"] for r in got}) == len(got)
    assert not {r["doc_id"] for r in got} & {1000, 1001, 1002, 1003}
    again = mixing.mix(docs, targets, block=50)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0
