"""The similarity join against every pair, and on lists that are split."""

import random

import pytest

from larkspur.functions import fuzzy
from larkspur.operators import similarity

WORDS = ["a", "ab", "abc", "blue", "blues", "bluer", "gear", "gears", "x1", "x2", "x10", "é", "widget", "𝔘"]


def texts(seed):
    rng = random.Random(seed)
    some = {" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) for _ in range(120)}
    return sorted(some | {"".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))).strip() for _ in range(60)})


@pytest.mark.parametrize("measure", similarity.MEASURES)
@pytest.mark.parametrize("seed,least,block", [(1, 90.0, 2048), (2, 80.0, 7), (3, 70.0, 7), (4, 100.0, 2048)])
def test_all_pairs_are_found(spark, monkeypatch, measure, seed, least, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    some, f = texts(seed), getattr(fuzzy, measure)
    df = spark.createDataFrame([(t, k) for k, t in enumerate([*some, None, some[3], some[3]])], "title string, id int")
    got = {(r.a, r.b): r.score for r in similarity.similar_pairs(df, "title", measure, least).collect()}
    full = [t for t in some if t]
    assert got == {(a, b): pytest.approx(f(a, b)) for i, a in enumerate(full) for b in full[i + 1 :] if f(a, b) >= least}


def test_few_candidates(spark):
    """Titles of few words: far fewer pairs meet the measure than there are."""
    some = [f"{a} {b} brand {k} {c}" for a in ("hot", "cold", "small") for b in ("ring", "plate", "gizmo") for k in range(20) for c in ("large", "promo")]
    rows = spark.createDataFrame(list(enumerate(some)), "id bigint, text string")
    n = similarity.candidates(rows, "ratio", 90.0).count()
    assert similarity.similar_pairs(rows, "text").count() <= n < 0.1 * len(some) * (len(some) - 1) / 2


def test_awkward_texts(spark):
    empty = spark.createDataFrame([], "t string")
    assert similarity.similar_pairs(empty, "t", "token_set").count() == 0
    long = "word " * 2000
    rows = spark.createDataFrame([(long + "a",), (long + "b",), ("",), (None,), (" ",)], "t string")
    assert [(r.a, r.b) for r in similarity.similar_pairs(rows, "t").collect()] == [(long + "a", long + "b")]
    for bad in (("ratio", 60.0), ("wratio", 90.0), ("ratio", 101.0)):
        with pytest.raises(ValueError):
            similarity.similar_pairs(rows, "t", *bad)
