"""The near-duplicate stage of the pipeline: five-word shingles, Jaccard similarity of 0.8 or more."""

import itertools
import os
import random
import re

import pytest

import corpus_pipeline
from larkspur.llm import overlap, secrets, simhash

SF_DIR = "/root/testdata/sf0.01"


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(texts):
    """The least id of each group, by every pair."""
    group, sets = {i: i for i in texts}, {i: slow_set(t) for i, t in texts.items()}
    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a], sets[b]
        if group[a] != group[b] and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
            old, new = sorted((group[a], group[b]))[::-1]
            group = {i: new if g == old else g for i, g in group.items()}
    return sorted(set(group.values()))


def kept(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return sorted(r.doc_id for r in simhash.keep_one(docs).collect())


def edited(words, rng, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("block", [5, 512])
def test_keep_one_equals_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng, texts = random.Random(4), ["", None, "a b", "A  b", "a b c"]
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(words), *(edited(words, rng, n) for n in (0, 1, len(words) // 60, len(words) // 40, len(words) // 30, len(words) // 15))]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    assert kept(spark, texts) == slow_kept(texts)


def test_similar_texts_of_distant_fingerprints(spark):
    rng = random.Random(7)
    far = lambda a, b: ((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())) % (1 << 64)).bit_count() > 3
    a = b = ""
    while not far(a, b):
        words = [f"w{rng.randrange(3000)}" for _ in range(100)]
        a, b = " ".join(words), edited(words, rng, 2)
    assert kept(spark, {1: a, 2: b, 3: "another text"}) == [1, 3]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_keep_one_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    assert kept(spark, texts) == slow_kept(texts)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages_from_near_duplicates_on(spark, tmp_path):
    docs, after = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[2:]):
        after.append(docs)
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    texts, unique, masked = ({r.doc_id: r for r in d.collect()} for d in after)
    assert sorted(unique) == slow_kept({i: r.text for i, r in texts.items()}) and len(unique) < len(texts)
    model = secrets.fit(after[1])
    assert masked.keys() == unique.keys()
    for i, r in masked.items():
        found = secrets.find(unique[i].text or "", model)
        assert r.n_chars == (None if r.text is None else len(r.text)) and (r.text == unique[i].text) == (not found)
        assert all(v not in r.text for _, _, _, v, _ in found)
    words = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in masked.values()}
    assert {r.doc_id: r.n_tokens for r in docs.collect()} == words
