"""Queries that take the whole of their input, by brute force."""

import os

import pytest

import __spark_entry__ as entry
from larkspur.queries.common import PAIRS, formed_pairs

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_source_rank_has_every_word(spark):
    got = {(r.doc_id, r.rank): r.word for r in entry.queries()["WN-02_source_rank"](spark, SF_DIR).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert got == {(i, k): w for i, t in texts.items() if t is not None for k, w in enumerate(t.split(" "), 1)}
    assert sum(map(len, got.values())) > 60 * len(texts)


def slow_ratio(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = best
        best = [0]
        for j, y in enumerate(b, 1):
            best.append(max(before[j], best[-1], before[j - 1] + (x == y)))
    return 200 * best[-1] / (len(a) + len(b)) if a or b else 100.0


def test_ratio_of_all_pairs(spark):
    forms = {r.pair_id: (r.a, r.b) for r in formed_pairs(spark, SF_DIR).selectExpr("pair_id", "query_form.normalized AS a", "title_form.normalized AS b").collect()}
    got = {r.pair_id: r.ratio for r in entry.queries()["SF-10_ratio"](spark, SF_DIR).collect()}
    parts = spark.read.parquet(f"{SF_DIR}/part.parquet").count()
    assert len(got) == len(PAIRS) + parts - 1
    assert got == pytest.approx({i: slow_ratio(a, b) for i, (a, b) in forms.items()})
