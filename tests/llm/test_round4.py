"""Steps of the pipeline: SimHash candidates of near duplicates, chunks of quality's steps."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import overlap, quality, simhash

from .test_methods import vectors


def test_simhash_proposes_near_duplicates(spark):
    """Without any band, nodes within three bits are candidates, and the exact distance decides."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(900)]
        texts += [" ".join(words), " ".join([*words, word()]), " ".join([word(), *words[1:]])]
    texts.append("")
    sets = [overlap.shingles(t.encode()) for t in texts]
    fps = [simhash.set_fingerprint(s) for s in sets]
    for s, fp in zip(sets[:3], fps, strict=False):  # by plain counts
        bits = "".join("1" if 2 * sum(int(h) >> b & 1 for h in s) > len(s) else "0" for b in range(63, -1, -1))
        assert int(bits, 2) == fp % (1 << 64)
    assert fps[-1] is None
    near = {(i, j) for i, j in itertools.combinations(range(len(texts) - 1), 2) if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 3}
    assert len(near) >= 10
    rows = spark.createDataFrame([(i, fp, i, t.encode(), []) for i, (fp, t) in enumerate(zip(fps, texts, strict=True))], "node bigint, fp bigint, row bigint, text binary, bands array<bigint>")
    found = overlap.links(rows.select("node", "bands"), rows.select("node", "row"), rows.select("row", "text"), simhash.near_nodes(rows.select("node", "fp")))
    label = list(range(len(texts)))
    for u, v in ((r.u, r.v) for r in found.collect()):
        label = [label[u] if x == label[v] else x for x in label]
    assert all(label[i] == label[j] for i, j in near)
    assert all(i // 3 == label[i] // 3 for i in range(len(texts)))


def test_steps_meet_estimates_by_chunks(spark, monkeypatch):
    """A step joins a few chunks of a group and not each of its rows; moments are those of all rows."""
    monkeypatch.setattr(quality, "CHUNK_ROWS", 300)
    x = np.random.default_rng(5).standard_normal((3000, 4))
    packed = quality._packed(vectors(spark, {7: x})).localCheckpoint()
    assert 5 <= packed.count() <= 10 and packed.select(F.sum(F.size("values"))).first()[0] == 3000
    flat = [1.0 if i == j else 0.0 for i, j in quality._PAIRS]
    estimates = spark.createDataFrame([(7, [0.0] * 4, flat)], "group bigint, centre array<double>, inverse array<double>")
    inside = x[(x**2).sum(1) <= 4]
    (row,) = quality._summed(packed, estimates, True, 4.0).collect()
    assert row.rows == len(inside) and np.allclose([row[f"m{i}"] for i in range(4)], inside.sum(0)) and np.isclose(row.c01, (inside[:, 0] * inside[:, 1]).sum())
    assert sum(r.rows for r in quality._summed(packed, estimates, True).collect()) == 3000
