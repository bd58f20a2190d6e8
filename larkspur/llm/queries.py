"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, chat, interaction, neighbours, packing, pieces, pii, quality, secrets, shards, simhash, spans, toxicity, trie
from .common import read_table, shared_dir


def piece_model() -> str:
    """Path of the SentencePiece model: ``LARKSPUR_PIECE_MODEL`` or the installed public one."""
    if path := os.environ.get("LARKSPUR_PIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_decode(read_table(spark, sf_dir, "documents"), piece_model())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Let the documents arrive in parts, compact after each, and read the last version back."""
    store = shards.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    shards.arrive(store, read_table(spark, sf_dir, "documents"), "doc_id")
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.log_of_turns(turns.unionByName(chat.escaping_probe(spark, turns)))
    return chat.read_back(chat.format_log(log), ordered=True)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    counts = [spans.count("secrets", k).alias(f"n_{k}") for k in secrets.KINDS]
    return out.select("doc_id", *counts, spans.base_digest("secrets").alias("base_sha256"), spans.joined("secrets").alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    counts = [spans.count("found", k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, spans.base_digest("found").alias("base_sha256"), spans.joined("found").alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(~toxicity.learnable(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_nearest": op2_nearest,
    "op3_quality": op3_quality,
    "op4_shards": op4_shards,
    "op5_chat": op5_chat,
    "op6_secrets": op6_secrets,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_interaction": op11_interaction,
    "op12_backoff": op12_backoff,
    "op13_prefix_trie": op13_prefix_trie,
}

#: The control strings of the chat template, as DuckDB replaces them.
_ESCAPE = r"regexp_replace({}, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g')"
_ROLE = _ESCAPE.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op4_shards": """
        SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
        FROM documents""",
    "op5_chat": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
            CAST(sum(8 + length({_ROLE}) + length({_ESCAPE.format('text')})) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op11_interaction": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        masks AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
            FROM texts LEFT JOIN (
                SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
        counts AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
        letters AS (SELECT substr('ABCDE', k + 1, 1) AS f, 1 << k AS b FROM range(5) t(k)),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
        steps AS (
            SELECT filter_order, step, f, b, (SELECT coalesce(sum(p.b), 0) FROM letters p WHERE contains(substr(filter_order, 1, step - 1), p.f)) AS before
            FROM orders, range(1, 6) t(step), letters WHERE f = substr(filter_order, step, 1)),
        walked AS (
            SELECT part, filter_order, CAST(step AS INT) AS step, f,
                CAST(sum(CASE WHEN mask & before = 0 AND mask & b = 0 THEN docs ELSE 0 END) AS BIGINT) AS kept,
                CAST(sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN docs ELSE 0 END) AS BIGINT) AS removed,
                CAST(sum(CASE WHEN mask & before <> 0 AND mask & b <> 0 THEN docs ELSE 0 END) AS BIGINT) AS redundant,
                CAST(sum(CASE WHEN mask = b THEN docs ELSE 0 END) AS BIGINT) AS unique_fails,
                CAST(sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                CAST(sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
            FROM counts, (SELECT filter_order, step, f, b, CAST(before AS BIGINT) AS before FROM steps) GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM walked""",
    "op13_prefix_trie": r"""
        WITH RECURSIVE placed AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        crc(c, s, k, v) AS (
            SELECT DISTINCT c, CAST(c AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM placed
            UNION ALL
            SELECT c, s, k + 1, list_reduce(list_prepend(xor(v, CAST(ascii(substr(s, k + 1, 1)) AS BIGINT)), CAST(range(8) AS BIGINT[])), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))
            FROM crc WHERE k < length(s)),
        convs AS (SELECT c, c - ((c % 5) + 5) % 5 AS base, xor(v, 4294967295) % 9 AS h FROM crc WHERE k = length(s)),
        turns AS (
            SELECT v.c, p.pos AS depth, p.role, p.text FROM convs v JOIN placed p ON p.c = v.base AND p.pos <= v.h
            UNION ALL
            SELECT v.c, p.pos - v.h + (SELECT count(*) FROM placed b WHERE b.c = v.base AND b.pos <= v.h), p.role, p.text FROM convs v JOIN placed p ON p.c = v.c AND p.pos > v.h),
        paths AS (
            SELECT c, 0 AS depth, '' AS key, 0 AS bytes FROM convs
            UNION ALL
            SELECT c, depth, sha256(string_agg(sha256(strlen(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY depth)) AS key, strlen(text) AS bytes FROM turns),
        nodes AS (SELECT depth, key, min(c) AS owner, count(*) AS n, max(bytes) AS bytes FROM paths GROUP BY depth, key),
        parents AS (
            SELECT n.depth, n.key, p.owner AS parent, u.key AS above FROM nodes n JOIN paths u ON u.c = n.owner AND u.depth = n.depth - 1 JOIN nodes p ON p.depth = u.depth AND p.key = u.key),
        children AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n FROM parents GROUP BY ALL),
        subtrees AS (
            SELECT a.depth, a.key, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((w.n - 1) * w.bytes) AS saved
            FROM nodes w LEFT JOIN children k USING (depth, key) JOIN paths a ON a.c = w.owner AND a.depth <= w.depth GROUP BY a.depth, a.key),
        ends AS (
            SELECT depth, key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha
            FROM (SELECT c, max(depth) AS depth FROM paths GROUP BY c) JOIN paths USING (c, depth) GROUP BY depth, key)
        SELECT n.owner AS conv_id, CAST(depth AS BIGINT) AS depth, p.parent AS parent_conv_id, n.n AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
            CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
        FROM nodes n JOIN subtrees s USING (depth, key) LEFT JOIN parents p USING (depth, key) LEFT JOIN children k USING (depth, key) LEFT JOIN ends e USING (depth, key)""",
}
