"""The pipeline's stages over small tables, against brute force and on awkward rows."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import quality, secrets, simhash, toxicity

from .test_operators import AWKWARD, DOCS, slow_counts
from .test_overlap import slow_kept

SF_DIR = "/root/testdata/sf0.001"
LABELS = "doc_id bigint, quality int, toxic int"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]
    before, after = [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before.append(docs)
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after.append(docs)
        assert (docs.columns == columns) == (name != "packing")
    # toxicity: every text against every example, by plain dot products
    model = toxicity.fit(before[0], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    spot, kept, vectors = toxicity.Spotter(model.index.vocabulary), [], model.index.vectors
    for r in before[0].collect():
        q = model.index.vector(spot(r.text or ""))
        own = model.own.get(toxicity.text_hash(toxicity.words_of(r.text or "")))  # an example is no neighbour of its own text
        cosines = [(sum(w * v.get(t, 0.0) for t, w in q.items()), i) for i, v in enumerate(vectors) if i != own]
        near = sorted((c for c in cosines if c[0] > 0), key=lambda c: (-c[0], c[1]))[: toxicity.NEIGHBOURS]
        if model.score(near) < 0.5:
            kept.append(r.doc_id)
    assert ids(after[0]) == sorted(kept)
    # quality: base rules by plain counts; then the verdict of each row
    texts = {r.doc_id: r.text or "" for r in before[1].collect()}
    verdict = {r.doc_id: r for r in quality.judge(before[1]).collect()}
    for i, t in texts.items():
        n, *_, repeated = slow_counts(t)
        assert verdict[i].base_failed == (n < 50 or 100 * repeated > 50 * n)
    assert ids(after[1]) == sorted(i for i in texts if verdict[i].kept)
    # near duplicates: every pair of sets of five-word shingles
    assert ids(after[2]) == slow_kept({r.doc_id: r.text for r in before[2].collect()})
    # secrets: the rules' matches are gone, texts without any are as they were
    texts, masked = ({r.doc_id: r for r in d.collect()} for d in (before[3], after[3]))
    model = secrets.fit(before[3])
    assert masked.keys() == texts.keys()
    for i, r in masked.items():
        assert r.n_chars == len(r.text) and (r.text == texts[i].text) == (not secrets.find(texts[i].text, model))
        assert all(v not in r.text for _, _, _, v, _ in secrets.find(texts[i].text, model))
    # packing: every row once
    words = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in masked.values()}
    dealt = after[4].collect()
    assert {r.doc_id: r.n_tokens for r in dealt} == words and len(dealt) == len(words) > 0


def test_run_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame(AWKWARD, DOCS).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, None, None), (4, 0, None), (9, 1, 1)], LABELS).write.parquet(f"{tmp_path}/some/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() <= len(AWKWARD)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_names_that_stages_use_can_be_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    columns = ["__fp", "__once", "__text", "__lang", "__source", "__limit", "group", "distance", "rows", "row", "n", "cell", "bucket", "centre"]
    base = spark.createDataFrame([(1, text, "en", "a", 9), (2, text, "en", "a", 9), (3, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = base.select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in columns))
    for kept in (simhash.keep_one(docs), quality.keep_good(docs), secrets.mask_secrets(docs)):
        assert kept.columns == docs.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in kept.collect() for c in columns)
    assert quality.judge(docs).count() == simhash.near_duplicates(docs).count() == 3
