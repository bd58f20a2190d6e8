"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat, neighbours, packing, pieces, pii, quality, secrets, shards, simhash, toxicity
from larkspur.llm.chisquare import cdf, quantile
from larkspur.llm.graph import components
from larkspur.llm.queries import piece_model

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `count` string, fp string, id string, label string"
#: Null id, null and empty text, repeated rows, a long text, extra columns with names that operators use.
AWKWARD = [
    (1, "plain words here", "en", "a", 16, "x", "x", "x", "x"),
    (1, "plain words here", "en", "a", 16, "x", "x", "x", "x"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", None, 0, "", "", "", ""),
    (None, "no id token = abcdef123456", "de", "b", 5, "x", "x", "x", "x"),
    (4, "word " * 60_000, "en", "a", 300_000, "x", "x", "x", "x"),
    (5, "x" * 200_000, "en", "a", 200_000, "x", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOCS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# 1: pieces


def test_pieces_equal_the_library():
    import sentencepiece

    table = pieces.ChunkTable(piece_model(), limit=50)
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rng = random.Random(1)
    letters = " ▁ ab the\n\t<s></s>é日 \U0001f600́​\x00　Ａ"
    texts = ["", " ", "  ", "a ", " a", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000))]
    for k in range(0, len(texts), 100):
        some = texts[k : k + 100]
        ids = table.encode(some)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [sp.encode(t, add_bos=True, add_eos=True) for t in some]
        assert table.decode(ids) == [sp.decode(sp.encode(t)) for t in some]


def test_pieces_on_awkward_rows(docs, nothing):
    out = pieces.encode_decode(docs, piece_model()).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in AWKWARD)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {2}
    assert pieces.encode_decode(nothing, piece_model()).count() == 0


# 2: nearest neighbours


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 150)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 20)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 12)) * rng.uniform(0.2, 2, (900, 1))
    x[600:800] = x[600]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0]), (1004, [None] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()
    hits = 0
    for q in range(0, 900, 20):
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        scores = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:20]
        hits += len({r.vec_id for r in got} & set(want))
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert all(abs(r.score - scores[r.vec_id]) < 1e-9 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
    assert hits >= 0.9 * 20 * 45
    assert neighbours.nearest(df.where("vec_id > 999"), df).count() == 0


def test_chi_square():
    assert abs(cdf(quantile(0.99, 8), 8) - 0.99) < 1e-9 and abs(quantile(0.95, 4) - 9.4877) < 1e-3


# 3: quality


def slow_counts(t):
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows, inside = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(inside)


def test_counts():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("aab \n\t#é\x1c\x85  ") for _ in range(rng.randint(0, 60)))
        assert quality.counts(t) == slow_counts(t)


def test_outliers_are_rejected_and_others_kept(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    good = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(60, 400))), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(w + rng.choice(["###", "$$$"]) for w in rng.choices(vocabulary, k=100)), "en", "a") for i in range(30)]
    odd = [(2000, "too short", "en", "a"), (2001, None, None, None), (2002, "x y z " * 50, "en", "a"), (2003, " ".join(vocabulary[:80]), "xx", None)]
    df = spark.createDataFrame(good + junk + odd, "doc_id bigint, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(out[i].kept for i, *_ in good) and not any(out[i].kept for i, *_ in junk)
    assert out[2000].base_failed and out[2001].base_failed and out[2002].base_failed and out[2003].kept
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}


def test_quality_on_awkward_rows(docs, nothing):
    assert quality.judge(docs).count() == len(AWKWARD)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judge(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


# 4: shards


def test_store_keeps_all_rows_and_versions(spark, docs, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fanout=3)
    arrivals = [spark.range(i * 100, i * 100 + 100).selectExpr("id", "cast(id AS string) AS text").coalesce(1) for i in range(7)]
    for a in arrivals:
        store.append(a)
    assert store.versions() == list(range(1, 8)) and len(store.manifest().shards) == 7
    now = store.compact(vacuum=False)
    assert len(now.shards) < 3 and sorted(r.id for r in store.read().collect()) == list(range(700))
    assert store.read(3).count() == 300 and store.due(now) == []
    with pytest.raises(shards.Conflict):
        store._commit(shards.Manifest(3, now.schema, ()))
    with pytest.raises(ValueError):
        store.append(spark.range(1))
    other = shards.ShardStore(spark, str(tmp_path / "t"))
    other.append(docs.limit(0))
    other.append(docs)
    other.compact()
    assert sorted(map(str, other.read().collect())) == sorted(map(str, docs.collect()))


# 5: chat


def test_escaping_round_trip():
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<s>", "\n", "a", "é"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and chat.unescape_role(chat.escape_role(s)) == s
        assert not re.search(r"</?s>|\[/?INST\]", chat.escape(s))


def test_fold_and_read_back(spark):
    log = [
        (1, 0, 1, 0, "open", "user", None), (1, 0, 1, 1, "delta", None, "hel"), (1, 0, 1, 2, "delta", None, "lo</s>"),
        (1, 1, 1, 0, "open", "assistant", None), (1, 1, 1, 1, "delta", None, "draft"), (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 3, "delta", None, "final"),
        (1, 2, 1, 0, "open", "assistant", None), (1, 2, 1, 1, "delta", None, "a"), (1, 2, 1, 2, "edit", None, "edited"), (1, 2, 1, 3, "delta", None, "!"), (1, 2, 1, 4, "strange", None, "x"),
        (None, None, 1, 0, "open", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id bigint, turn bigint, copy int, seq int, kind string, role string, text string")
    made = chat.format_log(df)
    rows = sorted(((r.conv_id, r.position, r.role, r.text) for r in made.collect()), key=str)
    assert rows == sorted([(1, 0, "user", "hello</s>"), (1, 1, "assistant", "final"), (1, 2, "assistant", "edited!"), (None, 0, "", "")], key=str)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhello</s>\nassistant\nfinal\nassistant\nedited!\n").hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (12, hashlib.sha256(b"finaledited!").hexdigest())
    assert chat.read_back(chat.format_log(df.limit(0))).count() == 0


def test_turns_with_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "assistant", "y" * 1000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    r = chat.read_back(chat.format_log(chat.log_of_turns(df))).first()
    text = "user\na\nuser\na\nuser\nb\nassistant\n\nassistant\n" + "y" * 1000 + "\n"
    assert (r.n_turns, r.turns_sha256, r.loss_chars) == (5, hashlib.sha256(text.encode()).hexdigest(), 1000)


# 6: secrets


def slow_secrets(t):
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_secret_rules():
    rng = random.Random(4)
    parts = ["token", "SeCret", "toKen", "apikey", "API_key", "passwd", "password", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "abcdef0123", "0123456789abcdef", "zz", ".", "_", "é", "K", "ſ"]
    for _ in range(10_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [s[:3] for s in secrets.base_spans(t)] == slow_secrets(t)


def test_inferred_formats(spark):
    rng = random.Random(5)
    key = lambda: "sk_" + "".join(rng.choice("0123456789ABCDEF") for _ in range(24))
    rows = [(i, f"token = {key()} and more") for i in range(200)] + [(1000, f"see {key()} there"), (1001, "internationalization2 of-very-long-hyphenated-words2"), (1002, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = secrets.fit(df)
    assert "assign" in model and len(model["assign"].states) < 60
    out = {r.doc_id: r.secrets for r in secrets.find_secrets(df, model).collect()}
    assert [(s.kind, s.base) for s in out[1000]] == [("format", False)] and out[1001] == [] and out[1002] == []
    assert all([s.kind for s in out[i]] == ["assign"] for i in range(200))
    hidden = {r.doc_id: r.text for r in secrets.mask_secrets(df, model).collect()}
    assert hidden[1000] == "see [SECRET] there" and hidden[0] == "[SECRET] and more" and hidden[1002] is None


def test_secrets_on_awkward_rows(docs, nothing):
    out = secrets.find_secrets(docs).collect()
    assert len(out) == len(AWKWARD) and [s.kind for r in out if r.doc_id is None for s in r.secrets] == ["assign"]
    assert secrets.find_secrets(nothing).count() == 0 and secrets.mask_secrets(docs, {}).columns == docs.columns


# 7: personal data


def slow_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_rules():
    rng = random.Random(6)
    for _ in range(10_000):
        letters = rng.choice(["ab@@.-+1 ", "0123.. ", "0123456789 -+().", "a@b.c+1 _é"])
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == slow_pii(t)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail me: john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("jane at mail dot example dot org please", "email", "jane at mail dot example dot org"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one five five five two one two three four", "phone", "plus one five five five two one two three four"),
        ("at one nine two dot one six eight dot one dot two five", "ip", "one nine two dot one six eight dot one dot two five"),
        ("4​929​348385146306", "card", "4​929​348385146306"),
    ],
)
def test_disguises_map_back(text, kind, source):
    found = [(k, text[a:b]) for k, a, b, _, base in pii.find(text) if not base]
    assert (kind, source) in found


def test_rewriting_maps_every_span_back():
    r = pii.Rewritten("ab12cd", [(2, 4, "X"), (5, 5, "Y")])
    assert r.text == "abXcYd" and r.back(0, 2) == (0, 2) and r.back(1, 3) == (1, 4) and r.back(2, 4) == (2, 5) and r.back(5, 6) == (5, 6)


def test_pii_leaves_plain_text_alone(docs, nothing):
    for t in ("un deux trois soleil", "meet at noon or dot the line", "seis al dot com at home"):
        assert pii.find(t) == []
    assert pii.find_personal_data(docs).count() == len(AWKWARD) and pii.find_personal_data(nothing).count() == 0


# 8: toxicity


def test_toxicity_is_learned_and_exact(spark, docs, nothing):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(800)]
    bad = ["zonk", "vrek", "quorp"]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(20, 80))
        if i % 5 == 0:
            words[3:3] = rng.choices(bad, k=3)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    df, marked = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(df, marked)
    out = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(out[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.97
    kept = {r.doc_id for r in toxicity.without_toxic(df, model).collect()}
    assert kept == {i for i, s in out.items() if s < 0.5}
    dense = np.zeros((len(model.index.vectors), len(model.index.vocabulary)))
    for i, v in enumerate(model.index.vectors):
        dense[i, list(v)] = list(v.values())
    for q in dense:
        exact = np.sort((dense @ q)[dense @ q > 0])[::-1][: toxicity.NEIGHBOURS]
        near = model.index.nearest({t: float(q[t]) for t in np.flatnonzero(q)})
        assert np.allclose([s for s, _ in near], exact)
    awkward = toxicity.score(docs, model).collect()
    assert len(awkward) == len(AWKWARD) and all(0 <= r.score <= 1 for r in awkward)
    empty = toxicity.fit(nothing, marked.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, empty).collect())


# 9: near duplicates


def slow_fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, ids):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(fps))]


def test_fingerprints():
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice("AbÉ \n\t\x85x") for _ in range(rng.randint(0, 50)))
        assert simhash.fingerprint(t.encode()) % (1 << 64) == slow_fingerprint(t)


@pytest.mark.parametrize("block", [40, 4096])
def test_links_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(0)
    base, fps = rng.integers(0, 1 << 63, 8, dtype=np.uint64), set()
    for _ in range(700):
        x = int(base[rng.integers(8)])
        for k in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(k)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    label = {r.node: r.label for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))).collect()}
    assert [label.get(x, x) for x in signed] == slow_groups(fps, signed)


def test_near_duplicates_on_awkward_rows(docs, nothing):
    out = simhash.near_duplicates(docs).collect()
    ids = [r[0] for r in AWKWARD]
    want = slow_groups([slow_fingerprint(r[1] or "") if len(r[1] or "") < 1000 else simhash.fingerprint(r[1].encode()) % (1 << 64) for r in AWKWARD], [i if i is not None else 1 << 60 for i in ids])
    assert sorted(((r.doc_id, r.component) for r in out), key=str) == sorted(((i, w if w < 1 << 60 else None) for i, w in zip(ids, want)), key=str)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(["1", "2", "None", "4", "5"])
    assert simhash.keep_one(nothing).count() == 0


# 10: packing


def test_tops_are_optimal():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(1, 9)
        tops, counts, b = sorted(rng.sample(range(1, 60), n)), [rng.randint(1, 9) for _ in range(n)], rng.randint(1, 4)
        cost = lambda ts: sum(k * min(x for x in ts if x >= t) for t, k in zip(tops, counts))  # noqa: B023, E731
        got = packing.optimal_tops(tops, counts, b)
        assert len(got) <= b and cost(got) == min(cost((*s, tops[-1])) for r in range(b) for s in itertools.combinations(tops[:-1], r))


def test_batches(spark, monkeypatch, docs, nothing):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 20)
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 50, 51, 300, 2000]))) for i in range(500)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), buckets=4, token_budget=600).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == [(i, len(t.split())) for i, t in rows]
    assert all(r.n_tokens <= r.padded_to for r in out)
    batches = {}
    for r in out:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        size = max(1, 600 // max(1, members[0].padded_to))
        assert sorted(m.slot for m in members) == list(range(len(members))) and len(members) <= size
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or len(members) == size
    assert packing.pack(docs).count() == len(AWKWARD) and packing.pack(nothing).count() == 0
