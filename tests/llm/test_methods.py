"""The dealt methods themselves, against brute force, and defects of the first round."""

import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, neighbours, overlap, packing, pii, quality, secrets, shards, simhash, toxicity

# 3: minimum covariance determinant


def test_steps_find_the_best_subset():
    rng = np.random.default_rng(0)
    for _ in range(10):
        x = rng.standard_normal((12, 2))
        x[:2] += 9
        centre, inverse, logdet = quality.concentrated(x, np.zeros((12, 2)), 9)
        best = min(itertools.combinations(range(12), 9), key=lambda k: np.linalg.det(np.cov(x[list(k)].T, bias=True)))
        assert np.allclose(centre, x[list(best)].mean(0)) and abs(logdet - math.log(np.linalg.det(np.cov(x[list(best)].T, bias=True)))) < 1e-6


def vectors(spark, groups):
    """Rows as ``quality.estimate`` takes them, from arrays by group."""
    rows = [(g, len(x), *map(float, v), 0.0, 0.0, 0.0, 0.0) for g, x in groups.items() for v in x]
    names = ", ".join([*(f"s{i} double" for i in range(4)), *(f"u{i} double" for i in range(4))])
    return spark.createDataFrame(rows, f"group bigint, of bigint, {names}")


@pytest.mark.parametrize("start_rows", [1500, 300])
def test_estimates_of_normal_groups(spark, monkeypatch, start_rows):
    monkeypatch.setattr(quality, "START_ROWS", start_rows)
    rng = np.random.default_rng(1)
    groups = {}
    for g, scale in enumerate((1.0, 10.0)):
        x = rng.standard_normal((1200, 4)) @ rng.standard_normal((4, 4)) * scale + g
        x[:200] = rng.standard_normal((200, 4)) * scale + 100 * scale  # a sixth of the rows lies apart
        groups[g] = x
    out = {r.group: r for r in quality.estimate(vectors(spark, groups), True).collect()}
    for g, x in groups.items():
        inverse = np.zeros((4, 4))
        for w, (i, j) in zip(out[g].inverse, quality._PAIRS):
            inverse[i, j] = inverse[j, i] = w
        d = quality._squared(x, np.array(out[g].centre), inverse)
        assert 2.9 < np.median(d[200:]) < 3.9 and d[:200].min() > 48


def texts_of_spread(spread, n=150, seed=0):
    """Texts whose words have a mean length that varies between texts by ``spread``."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        longer = rng.gauss(0, spread)
        words = ["".join(rng.choice("abcdefgh") for _ in range(max(1, round(rng.gauss(10 + longer, 1))))) for _ in range(120)]
        out.append(" ".join((w.capitalize() if rng.random() < 0.2 else w) + ("." if rng.random() < 0.2 else "") for w in words))
    return out


def test_verdict_follows_the_spread_of_the_group(spark):
    odd = texts_of_spread(0, 1, seed=9)[0].replace("a", "abc")
    verdict = {}
    for source, spread in (("narrow", 0.05), ("wide", 1.5)):
        rows = [(i, t, "en", source) for i, t in enumerate([*texts_of_spread(spread), odd])]
        out = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).orderBy("doc_id").collect()
        verdict[source] = out[-1].kept
        assert sum(r.kept for r in out[:-1]) == 150 and not any(r.base_failed for r in out)
    assert verdict == {"narrow": False, "wide": True}


# 6: automata


def test_lengths_and_fixed_characters_survive():
    rng = random.Random(5)
    of = lambda n, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(n))
    fixed = secrets.infer([of(40) for _ in range(150)])
    assert len(fixed.states) == 41 and [n for n, ok in enumerate(fixed.possible) if ok] == [40]
    two = secrets.infer([x for _ in range(100) for x in ("ghp_" + of(12, "ABCDEF0123456789"), "xo-" + of(20))])
    assert {"g", "x"} <= two.states[0].fixed.keys()
    assert two.score("ghp_" + "A1" * 6) >= two.threshold > two.score("ghp_" + "a1" * 6)
    free = secrets.infer([of(rng.randint(8, 30), "abcdefghijklmnopqrstuvwxyz") for _ in range(300)])
    assert len(free.states) < 15  # lengths vary, so states merge into loops


def test_probabilities_are_those_of_the_merged_counts():
    values = ["ab", "abab", "ababab"] * 20
    tree = secrets._Tree(sorted(values))
    assert tree.arrivals[0] == 60 and tree.fixed[0]["a"][0] == 60
    made = secrets.infer(values)
    # all strings over one letter, of geometric length: one state, whose shares are those of all arrivals
    loop = secrets.infer(["a" * n for n in range(1, 12) for _ in range(2 ** (12 - n))])
    ends, arrivals = sum(2 ** (12 - n) for n in range(1, 12)), sum(2 ** (12 - n) * (n + 1) for n in range(1, 12))
    assert len(loop.states) <= 3
    if len(loop.states) == 1:
        assert abs(loop.states[0].end - ends / arrivals) < 1e-9
    for state in made.states:
        assert abs(state.end + sum(p for p, _ in state.fixed.values()) + (state.other[0] if state.other else 0) - 1) < 1e-9
    assert made.likelihood("abab") > made.likelihood("abba") and made.likelihood("ab") > made.likelihood("aab")


def test_planted_formats_are_found_and_words_left(spark):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("abcdefghjkmnpqrstuvwxyz23456789") for _ in range(12))
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 14))) for _ in range(400)]
    prose = lambda: " ".join(rng.choices(vocabulary, k=40))
    rows = [(i, f"{prose()} api_key: {key()} {prose()}") for i in range(200)]
    hidden = {1000 + i: key() for i in range(100)}
    rows += [(i, f"{prose()} see ({k}). {prose()}") for i, k in hidden.items()] + [(2000 + i, prose() + " internationalize") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.secrets for r in secrets.find_secrets(df).collect()}
    found = sum([s.value for s in out[i] if not s.base] == [k] for i, k in hidden.items())
    wrong = sum(not s.base for i, spans in out.items() if i not in hidden for s in spans)
    assert found >= 90 and wrong <= 2
    assert all(s.bits is not None and s.bits > 0 for i in range(200) for s in out[i])


def test_possible_lengths_lose_nothing():
    rng = random.Random(7)
    made = secrets.infer(["".join(rng.choice("0123456789ab") for _ in range(rng.randint(6, 9))) for _ in range(80)])
    for _ in range(3000):
        v = "".join(rng.choice("0123456789abz") for _ in range(rng.randint(1, 14)))
        if made.score(v) >= made.threshold:
            assert made.possible[len(v)]


# 7: deobfuscation by brute force over templates


def test_every_disguise_of_every_template_maps_back():
    at = ["@", " at ", " [at] ", "(at)", " @ ", "<at>"]
    dot = [".", " dot ", "[dot]", " (dot) ", " [.] "]
    for a, d, before, after in itertools.product(at, dot, ("", "mail "), ("", " please", ", thanks")):
        if (a, d) == ("@", "."):
            continue
        source = f"jane.doe1{a}example{d}com"
        text = f"{before}{source}{after}"
        found = [text[x:y] for k, x, y, _, _ in pii.find(text) if k == "email"]
        assert source in found, (text, found)
    for words in pii.SPELLED:
        number = [random.Random(1).choice(words) for _ in range(10)]
        text = "call plus " + " ".join(number) + " now"
        assert [(k, text[x:y]) for k, x, y, _, _ in pii.find(text)] == [("phone", "plus " + " ".join(number))]


# texts of any length, in time proportional to it


LONG = 200_000
LONG_TEXTS = [c * LONG for c in " 1@+[a.-_\t"] + [
    "x" + " " * LONG + "[at]", ("[" + " " * 50) * (LONG // 51), "a@" * (LONG // 2), "1." * (LONG // 2), "+1 " * (LONG // 3), "x at " * (LONG // 5), "a@x dot " * (LONG // 8),
    "one two three " + "1" * LONG + "a", "one two three" + " " * LONG + "four", "ab.c" + " " * LONG + "at" + " " * LONG + "x.com", "token= " * (LONG // 7), "token" + " " * LONG, "token=" + "a" * LONG,
]


@pytest.mark.parametrize("work", [pii.find, lambda t: secrets.find(t, {}), quality.counts, lambda t: simhash.fingerprint(t.encode()), lambda t: overlap.bands(overlap.shingles(t.encode())), toxicity.words_of, chat.escape])
def test_long_texts_take_linear_time(work):
    for text in LONG_TEXTS:
        began = time.perf_counter()
        work(text)
        assert time.perf_counter() - began < 5, text[:20]


# 2: vectors of any size, levels of cells, awkward columns


def recall(x, out):
    ids, hits, wanted = np.arange(len(x)), 0, 0
    for q in range(0, len(x), 20):
        got = {r.vec_id: r.score for r in out if r.query_id == q}
        scores = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        hits, wanted = hits + len(set(want) & set(got)), wanted + len(want)
        assert all(math.isclose(s, scores[i], rel_tol=1e-9) for i, s in got.items())
    return hits / wanted


@pytest.mark.parametrize("size", [1e25, 1e-25, None])
def test_vectors_of_any_size(spark, size):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16)) * (size or 10.0 ** rng.integers(-25, 26, 400)[:, None])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    assert recall(x, neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()) > 0.99


def test_two_levels_of_cells(spark, monkeypatch):
    for name, value in (("MOST_CELLS", 4), ("BLOCK_ROWS", 100), ("QUERY_ROWS", 20)):
        monkeypatch.setattr(neighbours, name, value)
    x = np.random.default_rng(0).standard_normal((1500, 12))
    x[500:800] = x[500]
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, cell string, id int")
    assert recall(x, neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()) >= 0.95


def test_equal_ids_count_once(spark):
    rows = [(i % 30, [float(i), 1.0], "x", "y", 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, p string, rank string, query int")
    out = neighbours.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in out] == list(range(29, 9, -1)) and out[0].score == 30.0 * 59 + 1


# 9: buckets lose no pair within three bits


def test_some_bucket_has_every_close_pair(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << bit
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    keys = lambda c: F.array(*simhash._keys())
    df = spark.createDataFrame(pairs, "x bigint, y bigint")
    a, b = (df.select(F.col(c).alias("fp")).select(keys(c).alias("k")).collect() for c in ("x", "y"))
    assert all(set(p.k) & set(q.k) for p, q in zip(a, b, strict=True))


# 10: packing end to end


def test_pack_has_the_least_padding(spark):
    rng = random.Random(3)
    lengths = [rng.choice([1, 2, 3, 5, 8, 13, 400, 401, 640]) for _ in range(300)]
    rows = [(i, " ".join(["w"] * n), "x", 1, 2) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n string, row int, cell int")
    for buckets in (1, 3, 5):
        out = packing.pack(df, buckets=buckets, token_budget=1000).collect()
        distinct = sorted(set(lengths))
        best = min(sum(min(t for t in (*tops, distinct[-1]) if t >= n) - n for n in lengths) for tops in itertools.combinations(distinct[:-1], buckets - 1))
        assert sum(r.padded_to - r.n_tokens for r in out) == best
        sizes = Counter((r.bucket, r.batch) for r in out)
        tops = {r.bucket: r.padded_to for r in out}
        assert all(k <= max(1, 1000 // tops[b]) for (b, _), k in sizes.items())


# 4: the store


def test_store_types_vacuum_and_leftovers(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fanout=2)
    for i in range(4):
        store.append(spark.range(i * 10, i * 10 + 10).coalesce(1))
    with pytest.raises(ValueError):
        store.append(spark.range(3).selectExpr("cast(id AS string) AS id"))
    store._write(spark.range(5))  # a writer that died before its commit
    assert store.compact().version == 5 and sorted(r.id for r in store.read().collect()) == list(range(40))
    assert sorted(r.id for r in store.read(4).collect()) == list(range(40)) and store.vacuum() == 0
    assert store.vacuum(versions=1, older_than=0) >= 5 and store.versions() == [5]
    assert sorted(r.id for r in store.read().collect()) == list(range(40))


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = (shards.ShardStore(spark, str(tmp_path / "s"), fanout=2) for _ in range(2))
    one.append(spark.range(5))
    stale = two.manifest()
    one.append(spark.range(5, 9))
    seen = iter([stale, stale])
    fresh = shards.ShardStore.manifest
    monkeypatch.setattr(two, "manifest", lambda version=None: next(seen, None) or fresh(two, version))
    two.append(spark.range(9, 12))
    assert sorted(r.id for r in one.read().collect()) == list(range(12)) and one.versions() == [1, 2, 3]


# 5: rows in any order


def test_read_back_does_not_trust_the_order(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t}") for c in range(3) for t in range(6)]
    made = chat.format_log(chat.log_of_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    want = sorted(chat.read_back(made, ordered=True).collect())
    assert len(want) == 3 and sorted(chat.read_back(made.repartition(5)).collect()) == want
    with pytest.raises(Exception, match="should be"):
        chat.read_back(made.repartition(5), ordered=True).collect()


# 8: names and own texts


def test_toxic_stage_keeps_columns_and_own_label_out(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join([*rng.choices(words, k=40), *(["zonk", "vrek"] if i % 4 == 0 else [])]), "x", "y", "z") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string, id string, term string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels)
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 4}
    spot, text = toxicity.Spotter(model.index.vocabulary), {i: t for i, t, *_ in rows}
    for k, i in enumerate(model.index.examples):
        assert k not in [n for _, n in model.neighbours(text[i], spot)]
    assert not re.search("VOCABULARY|LEAST_", " ".join(vars(toxicity)))
    assert set().union(*(toxicity.words_of(text[i]) for i in model.index.examples)) == model.index.vocabulary.keys()
