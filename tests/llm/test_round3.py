"""Filter interaction, backoff scores and the prefix trie against brute force, and on awkward rows."""

import glob
import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import backoff, chat, common, interaction, pii, quality, shards, trie
from larkspur.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, part string, id string, mask int, digest string, n int, filter string"
TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, depth int, hi int"
MORE = (None, None, None, None, None)


# 4, 5, 7: what the last round left


def test_shards_of_one_file_are_merged(spark, tmp_path):
    """A table of one file arrives in parts, whose shards are merged; older versions can be read until vacuum."""
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert len(documents.inputFiles()) == 1
    store = shards.ShardStore(spark, f"{tmp_path}/store")
    shards.arrive(store, documents, "doc_id")
    assert store.versions()[-1] > shards.ARRIVALS and len(store.manifest().shards) < shards.ARRIVALS / 2
    assert sorted(r.doc_id for r in store.read().select("doc_id").collect()) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    store.append(documents.limit(3))
    before = store.versions()[-1]
    store.append(documents.limit(5))
    assert store.read(before).count() == documents.count() + 3 and store.read().count() == documents.count() + 8


def test_small_groups_have_their_own_estimate(spark):
    """Two sources of forty texts each with opposed centres: what is usual in one is an outlier in the other."""
    rng = random.Random(5)

    def text(letters):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(max(1, round(rng.gauss(letters, 1))))) for _ in range(rng.randint(80, 160))]
        words = [w.capitalize() if rng.random() < 0.1 else w for w in words]
        return " ".join(w + rng.choice([",", ".", ""]) for w in words)

    rows = [(k, text(4 if k % 2 else 12), "en", "short" if k % 2 else "long") for k in range(80)]
    rows += [(100, text(12), "en", "short"), (101, text(4), "en", "long")]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not kept[100] and not kept[101] and sum(kept.values()) >= 79


def test_one_long_turn_is_cut_in_linear_time(spark):
    def took(n):
        turns = spark.createDataFrame([(1, 0, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string").withColumn("text", F.repeat(F.lit("Ä😀\n z"), n // 5))
        began = time.perf_counter()
        row = chat.log_of_turns(turns).where("kind = 'delta'").agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("deltas"), F.max(F.length("text")).alias("most")).first()
        assert (row.n, row.deltas, row.most) == (n // 5 * 5, -(-(n // 5 * 5) // 256), 256)
        return time.perf_counter() - began

    took(1000)
    assert took(20_000_000) < 60


def test_many_spans_and_disguises_take_linear_time():
    def took(n):
        text = " ".join(f"a{k}@ex.com b{k} [at] ex.com" for k in range(n))
        began = time.perf_counter()
        found = pii.find(text)
        assert sum(base for *_, base in found) == n and len(found) == 2 * n
        return time.perf_counter() - began

    small = took(5000)
    assert took(100_000) < 60 * small + 1


def test_folders_of_two_runs_do_not_meet(spark):
    with common.own_folders(spark):
        mine = common.written(spark.range(3), "mine")
        with ThreadPoolExecutor(1) as other:

            def run():
                with common.own_folders(spark):
                    return common.written(spark.range(4), "other").count()

            assert other.submit(run).result() == 4
        assert mine.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        spark.read.parquet(*mine.inputFiles()).count()


# 11: filter interaction


def slow_audit(docs, labels):
    """Every order walked for every document."""
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    fails = []
    for i, text, lang in docs:
        t = text or ""
        words = t.encode().split()
        f = {c for c, x in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), set(t) & set("#$%&*|")), strict=True) if x}
        if any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs):
            f.add("E")
        fails.append((i, lang or "", f))
    out = defaultdict(Counter)
    for part in {p for _, p, _ in fails}:
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                row = out[part, "".join(order), k + 1]
                for i, p, f in fails:
                    if p == part:
                        gone, here = bool(f & set(order[:k])), c in f
                        row.update(
                            kept=not gone and not here, removed=not gone and here, redundant=gone and here, unique_fails=f == {c},
                            good_lost=not gone and here and i in good, toxic_lost=not gone and here and i in toxic,
                        )
    for part in {p for _, p, _ in fails}:
        total = Counter()
        for (p, order, step), row in out.items():
            if p == part:
                total[order[step - 1]] += row["removed"]
        for (p, order, step), row in out.items():
            if p == part:
                row["shapley"] = total[order[step - 1]]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_audit_equals_every_walk(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "a " * 250, " ".join(map(str, range(300))), "ABC " * 60, " ".join(f"w{k}" for k in range(220)) + " #", "Ä é ö " * 70, "x" * 100_000, " ".join(f"v{k}" for k in range(40_000))]
    docs = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(60)]
    labels = [(rng.choice([None, *range(25)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(30)]
    labels = [x for x in labels if x[0] is not None] + [(None, 1, 1)]
    df = spark.createDataFrame([(i, t, lang, *("x", "x", 1, "x", 2, "x")) for i, t, lang in docs], DOCS)
    out = interaction.audit(df, spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint")).collect()
    want = slow_audit(docs, [x for x in labels if x[0] is not None])
    assert len(out) == len(want)
    for r in out:
        assert {c: r[c] for c in want[r.part, r.filter_order, r.step]} == want[r.part, r.filter_order, r.step]


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint")
    assert interaction.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    some = spark.createDataFrame([(1, "a", "en", *("x", "x", 1, "x", 2, "x"))], DOCS)
    rows = interaction.audit(some, labels).collect()
    assert len(rows) == 600 and sum(r.removed for r in rows) == 120 and {r.good_lost for r in rows} == {0}


# 12: backoff automaton


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def slow_counts(rows, order):
    counts = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if i is not None and not held(i):
            s = [b" ", *(t or "").encode().lower().split(), b" "]
            counts[1].update((w,) for w in s[1:])
            for n in range(2, order + 1):
                counts[n].update(tuple(s[k : k + n]) for k in range(len(s) - n + 1))
    return counts


def slow_model(rows, order, mu):
    """The model by its definition: the probability of a token after a context."""
    counts = slow_counts(rows, order)
    total, distinct = sum(counts[1].values()), len(counts[1])

    def p(h, w):
        if not h:
            return (counts[1][(w,)] + 1) / (total + distinct + 1)
        below, seen = p(h[1:], w), counts[len(h)][h]
        return (counts[len(h) + 1][(*h, w)] + mu * below) / (seen + mu) if seen else below

    return p


def slow_scores(rows, order, mu):
    """One token at a time."""
    p, single = slow_model(rows, order, mu), slow_counts(rows, 1)[1]
    for i, t in rows:
        s = [b" ", *(t or "").encode().lower().split(), b" "]
        score = sum(math.log10(p(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))
        yield i, held(i), len(s) - 1, sum(single[(w,)] > 0 for w in s[1:]), sum(single.values()), sum(math.log10(p((), w)) for w in s[1:]), score


@pytest.mark.parametrize("order,block,parts", [(1, 50, 3), (2, 60, 5), (3, 40, 7), (4, 200, 1)])
def test_scores_equal_the_definition(spark, monkeypatch, order, block, parts):
    monkeypatch.setattr(backoff, "BLOCK_TOKENS", block)
    monkeypatch.setattr(backoff, "LEAST_PARTS", parts)
    rng = random.Random(order)
    words = ["a", "A", "b", "c", "dd", "é", "É", " ", "日", "</s>", "\x00"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(" \n\t\r\x0b\x0c  ") for _ in range(rng.choice([0, 1, 5, 30, 300])))) for i in range(80)]
    rows += [(None, "a b c"), (None, None), (3, None), (3, rows[3][1]), (81, ""), (82, " \n"), (16, rows[5][1])]
    df = spark.createDataFrame([(i, t, *("en", "x", "x", 1, "x", 2, "x")) for i, t in rows], DOCS).repartition(3)
    out = [tuple(r) for r in backoff.score(df, order=order, mu=2.5).collect()]
    key = lambda r: (str(r[0]), *r[1:5], round(r[6], 6))
    for got, want in zip(sorted(out, key=key), sorted(slow_scores(rows, order, 2.5), key=key), strict=True):
        assert got[:5] == want[:5] and got[5:] == pytest.approx(want[5:], rel=1e-9)


def test_scores_are_probabilities(spark):
    """After a context, the probabilities of all known tokens and of one unknown add up to one."""
    seen = [(0, "a b a c"), (3, "b a"), (4, "c c a b")]
    ids = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    texts = ["a b a", "a b b", "a b c", "a b unknown"]
    rows = seen + list(zip(ids, texts, strict=True))
    score = {r.doc_id: r.score for r in backoff.score(spark.createDataFrame(rows, "doc_id bigint, text string"), order=3, mu=1.5).collect()}
    # the price of the end after each is taken off by the model learned from the same texts
    ends = {"a b a": "b a", "a b b": "b b", "a b c": "b c", "a b unknown": "unknown"}
    model = slow_model(seen, 3, 1.5)
    total = sum(10 ** (score[i] - math.log10(model(tuple(ends[t].encode().split())[-2:] if "unknown" not in t else (b"b", b"unknown"), b" "))) for i, t in zip(ids, texts, strict=True))
    before = model((b" ",), b"a") * model((b" ", b"a"), b"b")
    assert total + before * model((b"a", b"b"), b" ") == pytest.approx(before)


def test_scores_on_awkward_rows(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert backoff.score(nothing).count() == 0
    long = [(9, "word " * 200_000), (9, "y" * 300_000), (16, None)]
    out = backoff.score(spark.createDataFrame([(i, t, *("en", "x", "x", 1, "x", 2, "x")) for i, t in long], DOCS)).collect()
    assert sorted(r.n_tokens for r in out) == [1, 2, 200_001] and all(math.isfinite(r.score) for r in out)
    out = backoff.score(spark.createDataFrame([(i, "a b") for i in range(50) if held(i)], "doc_id bigint, text string")).collect()
    assert {(r.held_out, r.n_known, r.train_tokens, r.score) for r in out} == {(True, 0, 0, 0.0)}


def test_held_out_texts_gain_over_single_tokens(spark):
    out = QUERIES["op12_backoff"](spark, SF_DIR).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


# 13: prefix trie


def slow_trie(turns):
    """Every prefix of every rebuilt conversation as a tuple."""
    logs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            logs[c].append(((turn is not None, turn or 0), role, digest, text))
    logs = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in logs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(logs):
        h = zlib.crc32(str(c).encode()) % 9
        path = (*logs.get(c - c % 5, [])[:h], *logs[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def trie_rows(spark, turns):
    out = trie.prefix_trie(spark.createDataFrame([(*t, "x", 1, 2) for t in turns], TURNS))
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed,chunk,piece", [(0, 4096, 4096), (1, 3, 2)])
def test_trie_equals_every_prefix(spark, monkeypatch, seed, chunk, piece):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "IDS_AT_ONCE", piece)
    rng = random.Random(seed)
    common = [("user" if k % 2 == 0 else "assistant", f"é{k}") for k in range(12)]
    turns = []
    for c in range(90):
        if c % 11 == 3:
            continue  # absent, also as the first of its five
        log = common[: rng.randint(0, 12)] + [(rng.choice(["user", None]), rng.choice(["x", "y", None, ""])) for _ in range(rng.randint(0, 4))]
        turns += [(c, k if rng.random() < 0.9 else k + 0, r, t) for k, (r, t) in enumerate(log)] or [(c, None, None, None)]
    turns += [(40, None, "user", "first of all"), (40, 2, "user", "a tie"), (40, 2, "user", "a tie"), (40, 2, "tool", "a tie"), (None, 0, "user", "no conversation"), (1000, 0, "user", "z" * 300_000)]
    turns += [(2000, k, "user", f"t{k % 5}") for k in range(300)]
    rng.shuffle(turns)
    assert trie_rows(spark, turns) == slow_trie(turns)


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "a")]) == []


def test_a_ladder_of_chains(spark):
    """Each conversation goes on one turn beyond the one before it: as many levels of chains as turns."""
    shared = [("user", f"t{k}") for k in range(30)]
    turns = [(5 * c, k, r, t) for c in range(30) for k, (r, t) in enumerate(shared[: c + 1])]
    assert trie_rows(spark, turns) == slow_trie(turns)


@pytest.mark.parametrize("name", ["op11_interaction", "op13_prefix_trie"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = QUERIES[name](spark, SF_DIR)
    result = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, result.fetchall()))
