"""Text, price and URL functions (SF, UR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, fuzzy, parse, text, urls
from ..operators import matching
from .common import DUCK_PAIRS, array, duck_any, duck_norm, expect, formed_pairs, on_pairs, pairs, query, table, values

STOP = array(fixed.STOPWORDS)


@query("SF-01_normalize_text", f"SELECT doc_id, sha256({duck_norm('text')}) AS normalized_sha256, CAST(length({duck_norm('text')}) AS BIGINT) AS n_chars FROM documents")
def sf01(spark, d):
    n = table(spark, d, "documents").select("doc_id", text.normalized("text").alias("n"))
    return n.select("doc_id", F.sha2(F.col("n").cast("binary"), 256).alias("normalized_sha256"), F.length("n").cast("bigint").alias("n_chars"))


@query("SF-02_tokens", f"""
    WITH n AS (SELECT doc_id, list_filter(string_split({duck_norm('text')}, ' '), lambda x: x <> '' AND NOT list_contains({STOP}, x)) AS k FROM documents)
    SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, sha256(array_to_string(k, ' ')) AS tokens_sha256 FROM n""")
def sf02(spark, d):
    k = table(spark, d, "documents").select("doc_id", text.tokens(text.normalized("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("k", " ").cast("binary"), 256).alias("tokens_sha256"))


@query("SF-03_model_tokens", on_pairs("array_to_string(qm, ',') AS query_models, array_to_string(tm, ',') AS title_models"))
def sf03(spark, d):
    return formed_pairs(spark, d).select("pair_id", F.array_join("query_form.model_tokens", ",").alias("query_models"), F.array_join("title_form.model_tokens", ",").alias("title_models"))


@query("SF-04_years", on_pairs("array_to_string(qy, ',') AS query_years, array_to_string(ty, ',') AS title_years"))
def sf04(spark, d):
    return formed_pairs(spark, d).select("pair_id", F.array_join("query_form.years", ",").alias("query_years"), F.array_join("title_form.years", ",").alias("title_years"))


def duck_inches(*blobs: str) -> str:
    found = [rf"regexp_extract_all({b}, '(?i){p}', 1)" for b in blobs for p in (r"\b([0-9]{2})\s*-?\s*inch\b", r"\b([0-9]{2})\s*class\b", "oled([0-9]{2})")]
    return f"list_sort(list_distinct(list_transform(flatten([{', '.join(found)}]), lambda x: CAST(x AS INTEGER))))"


@query("SF-05_inch_sizes", on_pairs(f"array_to_string(list_transform({duck_inches('t', 'url')}, lambda x: CAST(x AS VARCHAR)), ',') AS sizes"))
def sf05(spark, d):
    return formed_pairs(spark, d).select("pair_id", F.array_join(text.inch_sizes("title_form.normalized", "url").cast("array<string>"), ",").alias("sizes"))


def duck_series(n: str) -> str:
    return rf"regexp_extract_all('  ' || regexp_replace({n}, '([^a-z0-9])', '\1\1', 'g') || '  ', '[^a-z0-9]([0-9]{{2,3}})[^a-z0-9]', 1)"


@query("SF-06_series_numbers", on_pairs(f"array_to_string({duck_series('q')}, ',') AS numbers"))
def sf06(spark, d):
    return formed_pairs(spark, d).select("pair_id", F.array_join(text.series_numbers("query_form.normalized"), ",").alias("numbers"))


DUCK_CODES = "list_filter(qm, lambda c: length(c) >= 2 AND regexp_matches(c, '[0-9]') AND regexp_matches(c, '[a-z]') AND NOT regexp_full_match(c, 'm[1-9]'))"
DUCK_CHIPS = r"list_transform(regexp_extract_all({}, '\bm([1-9])\b', 1), lambda x: CAST(x AS INTEGER))"


@query("SF-07_model_codes", on_pairs(f"array_to_string({DUCK_CODES}, ',') AS codes"))
def sf07(spark, d):
    return formed_pairs(spark, d).select("pair_id", F.array_join(text.model_codes("query_form.model_tokens"), ",").alias("codes"))


@query("SF-08_chip_generations", on_pairs(f"list_max({DUCK_CHIPS.format('t')}) AS newest, list_min({DUCK_CHIPS.format('t')}) AS oldest"))
def sf08(spark, d):
    c = text.chips("title_form.normalized")
    return formed_pairs(spark, d).select("pair_id", F.array_max(c).alias("newest"), F.array_min(c).alias("oldest"))


@query("SF-09_asin", "SELECT page_id, nullif(upper(regexp_extract(url || '/dp/b0' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '?x', '(?i)/dp/([A-Z0-9]{10})', 1)), '') AS asin, nullif(upper(regexp_extract(url, '(?i)/dp/([A-Z0-9]{10})', 1)), '') AS own FROM pages")
def sf09(spark, d):
    p = table(spark, d, "pages").withColumn("u", F.concat("url", F.lit("/dp/b0"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit("?x")))
    return p.select("page_id", urls.asin("u").alias("asin"), urls.asin("url").alias("own"))


@query("SF-10_wratio")
def sf10(spark, d):
    return formed_pairs(spark, d).select("pair_id", fuzzy.similarity("wratio", "query_form.normalized", "title_form.normalized").alias("wratio"))


# the longest common subsequence by a row of the dynamic program at a time, one character of the query after the other
DUCK_LCS = """
steps(pair_id, a, b, i, best) AS (
    SELECT pair_id, a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM texts
    UNION ALL
    SELECT pair_id, a, b, i + 1,
        list_reduce(list_transform(range(1, length(b) + 1), lambda j: [best[j] + CASE WHEN substr(b, j, 1) = substr(a, i + 1, 1) THEN 1 ELSE 0 END, best[j + 1]]),
            lambda acc, x: list_append(acc, greatest(x[1], x[2], acc[len(acc)])), [0])
    FROM steps WHERE i < length(a))
"""


@query("SF-10_ratio", f"""
    WITH RECURSIVE {DUCK_PAIRS}, texts AS (SELECT pair_id, q AS a, t AS b FROM p), {DUCK_LCS}
    SELECT pair_id, CASE WHEN length(a) + length(b) = 0 THEN 100.0 ELSE 200.0 * best[len(best)] / (length(a) + length(b)) END AS ratio FROM steps WHERE i = length(a)""")
def sf10_ratio(spark, d):
    return formed_pairs(spark, d).select("pair_id", fuzzy.similarity("ratio", "query_form.normalized", "title_form.normalized").alias("ratio"))


# words of both sides, shared and own ones; then four pairs of strings for each pair: sorted words, and the three of token_set
DUCK_SETS = f"""
w AS (SELECT pair_id, list_filter(string_split(q, ' '), lambda x: x <> '') AS x, list_filter(string_split(t, ' '), lambda x: x <> '') AS y FROM p),
s AS (SELECT *, list_sort(list_distinct(list_filter(x, lambda v: list_contains(y, v)))) AS shared,
    list_sort(list_distinct(list_filter(x, lambda v: NOT list_contains(y, v)))) AS own_x, list_sort(list_distinct(list_filter(y, lambda v: NOT list_contains(x, v)))) AS own_y FROM w),
j AS (SELECT *, array_to_string(shared, ' ') AS i, array_to_string(list_concat(shared, own_x), ' ') AS ix, array_to_string(list_concat(shared, own_y), ' ') AS iy FROM s),
texts AS (
    SELECT pair_id * 4 AS pair_id, array_to_string(list_sort(x), ' ') AS a, array_to_string(list_sort(y), ' ') AS b FROM j
    UNION ALL SELECT pair_id * 4 + 1, ix, iy FROM j UNION ALL SELECT pair_id * 4 + 2, i, ix FROM j UNION ALL SELECT pair_id * 4 + 3, i, iy FROM j),
{DUCK_LCS},
r AS (SELECT pair_id, CASE WHEN length(a) + length(b) = 0 THEN 100.0 ELSE 200.0 * best[len(best)] / (length(a) + length(b)) END AS ratio FROM steps WHERE i = length(a)),
alike AS (SELECT j.pair_id, a.ratio AS token_sort, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN len(shared) > 0 AND (len(own_x) = 0 OR len(own_y) = 0) THEN 100.0
        WHEN len(shared) = 0 THEN b.ratio ELSE greatest(b.ratio, c.ratio, e.ratio) END AS token_set
    FROM j JOIN r a ON a.pair_id = j.pair_id * 4 JOIN r b ON b.pair_id = j.pair_id * 4 + 1 JOIN r c ON c.pair_id = j.pair_id * 4 + 2 JOIN r e ON e.pair_id = j.pair_id * 4 + 3)
"""


@query("SF-11_token_set", f"WITH RECURSIVE {DUCK_PAIRS}, {DUCK_SETS} SELECT pair_id, token_set, token_sort FROM alike")
def sf11(spark, d):
    similar = fuzzy.similarities(["token_set", "token_sort"], "query_form.normalized", "title_form.normalized")
    return formed_pairs(spark, d).select("pair_id", similar.alias("s")).select("pair_id", "s.*")


DUCK_RECALL = "CASE WHEN len(qm) = 0 THEN 1.0 ELSE len(list_filter(qm, lambda x: list_contains(tm, x))) / len(qm) END"


@query("SF-12_model_recall", on_pairs(f"CAST({DUCK_RECALL} AS DOUBLE) AS recall"))
def sf12(spark, d):
    return formed_pairs(spark, d).select("pair_id", text.recall("query_form.model_tokens", "title_form.model_tokens").alias("recall"))


def duck_new(strings: list[str]) -> str:
    return f"len(list_filter({array(strings)}, lambda x: contains(t, x) AND NOT contains(q, x)))"


@query("SF-13_bundle_penalty", on_pairs(f"CAST({duck_new(fixed.BUNDLE_WORDS)} * 8 + {duck_new(fixed.BUNDLE_MARKERS)} * 12 AS DOUBLE) AS penalty"))
def sf13(spark, d):
    return formed_pairs(spark, d).select("pair_id", text.bundle_penalty("query_form.normalized", "title_form.normalized").alias("penalty"))


DUCK_USED = r"regexp_matches(query, '(?i)\b(renewed|refurb(ished)?|open[-\s]?box|pre[-\s]?owned|used)\b')"
DUCK_NON_NEW = r"regexp_matches(title, '(?i)\b(renewed(\s+premium)?|refurb(ished)?|open[-\s]?box|pre[-\s]?owned|used\s*[-–]?\s*|certified\s+refurbished)\b')"


@query("SF-14_condition_penalty", on_pairs(f"CAST(CASE WHEN NOT {DUCK_USED} AND {DUCK_NON_NEW} THEN 22 ELSE 0 END AS DOUBLE) AS penalty"))
def sf14(spark, d):
    return pairs(spark, d).select("pair_id", text.condition_penalty("query", "title").alias("penalty"))


@query("SF-15_year_bonus", on_pairs("CAST(CASE WHEN len(qy) > 0 AND list_contains(ty, qy[1]) THEN 5 ELSE 0 END AS DOUBLE) AS bonus"))
def sf15(spark, d):
    return formed_pairs(spark, d).select("pair_id", matching.year_bonus(F.col("query_form"), F.col("title_form")).alias("bonus"))


@query("SF-16_score_title")
def sf16(spark, d):
    return matching.scored(formed_pairs(spark, d)).select("pair_id", "filtered", "score", "wratio", "token_set", "model_recall", "year_bonus", "condition_penalty")


PRICE_TEXTS = ["$1,234.56", "1.234,56", "$10 - $20", "$542.00$1,496.00", "-5", ".5", "5.", "$0.00", "1.2.3", "", "free", "USD 99", "1,299"]
RATING_TEXTS = ["4.5 out of 5", "47", "1,234 ratings", "51", "", "no rating", "5", "0", "3,9 von 5"]
COUNT_TEXTS = ["1,234 ratings", "4.5 out of 5 stars 1,234 ratings", "no reviews", "12 customer reviews", ",", "(88)"]


def texts(rows: list[str]) -> list[tuple]:
    return list(enumerate(rows))


def duck_price(x: str) -> str:
    v = f"TRY_CAST(regexp_replace({x}, '[^0-9.]', '', 'g') AS DECIMAL(38,10))"
    return f"CASE WHEN {v} > 0 THEN {v} END"


def _rows(spark, d, examples, name, key, made):
    """``i, s``: examples, and a text made from each row of a table."""
    rows = table(spark, d, name).select((F.col(key) + 1000).cast("int").alias("i"), F.expr(made).alias("s"))
    return spark.createDataFrame(texts(examples), "i int, s string").unionByName(rows)


def _sql_rows(examples, name, key, made):
    return f"(SELECT CAST(i AS INTEGER) AS i, s FROM {values(texts(examples), 'i, s')} UNION ALL SELECT CAST(1000 + {key} AS INTEGER), {made} FROM {name})"


@query("SF-17_parse_price", f"SELECT i, {duck_price('s')} AS price FROM {values(texts(PRICE_TEXTS), 'i, s')} UNION ALL SELECT CAST(1000 + p_partkey AS INTEGER), {duck_price("'$' || format('{:,.2f}', p_retailprice)")} FROM part")
def sf17(spark, d):
    rows = spark.createDataFrame(texts(PRICE_TEXTS), "i int, s string")
    parts = table(spark, d, "part").select((F.col("p_partkey") + 1000).cast("int").alias("i"), F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("s"))
    return rows.unionByName(parts).select("i", parse.price("s").alias("price"))


_SF18 = (RATING_TEXTS, "part", "p_partkey", "p_size || ',' || p_partkey % 10 || ' stars'")


@query("SF-18_parse_rating", f"""
    WITH r AS (SELECT i, TRY_CAST(regexp_extract(replace(s, ',', '.'), '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS v FROM {_sql_rows(*_SF18)}),
    x AS (SELECT i, CASE WHEN v > 5 AND v <= 50 THEN v / 10 ELSE v END AS v FROM r)
    SELECT i, CASE WHEN v BETWEEN 0 AND 5 THEN v END AS rating FROM x""")
def sf18(spark, d):
    return _rows(spark, d, *_SF18).select("i", parse.rating("s").alias("rating"))


_SF19 = (COUNT_TEXTS, "part", "p_partkey", "'(' || p_partkey || ',' || lpad(CAST(p_size AS STRING), 3, '0') || ' Ratings)'")


@query("SF-19_parse_review_count", f"SELECT i, TRY_CAST(replace(regexp_extract(lower(s), '([0-9,]+)', 1), ',', '') AS BIGINT) AS n FROM {_sql_rows(*_SF19)}")
def sf19(spark, d):
    return _rows(spark, d, *_SF19).select("i", parse.review_count("s").alias("n"))


SHOWN = ["N/A", "4.7", "1,234", "", "x"]


_SF20 = (SHOWN, "part", "p_partkey", "' ' || p_partkey || ',' || lpad(CAST(p_size AS STRING), 3, '0') || CASE WHEN p_size % 7 = 0 THEN '+' ELSE ' ' END")


@query("SF-20_shown_numbers", f"SELECT i, TRY_CAST(replace(trim(s), ',', '') AS DOUBLE) AS value FROM {_sql_rows(*_SF20)}")
def sf20(spark, d):
    return _rows(spark, d, *_SF20).select("i", parse.shown_number("s", "double").alias("value"))


JSON_PRICES = ["12.5", "-3", "0", "$1,299.00", "n/a", "99"]


_SF21 = (JSON_PRICES, "part", "p_partkey", "CASE WHEN p_size % 3 = 0 THEN '$' WHEN p_size % 3 = 1 THEN '-' ELSE '' END || p_partkey || '.5'")


@query("SF-21_coerce_price", f"SELECT i, CASE WHEN TRY_CAST(s AS DECIMAL(38,10)) IS NOT NULL THEN CASE WHEN TRY_CAST(s AS DECIMAL(38,10)) > 0 THEN TRY_CAST(s AS DECIMAL(38,10)) END ELSE {duck_price('s')} END AS price FROM {_sql_rows(*_SF21)}")
def sf21(spark, d):
    return _rows(spark, d, *_SF21).select("i", parse.coerced_price("s").alias("price"))


@query("SF-22_key", "SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_type), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM part")
def sf22(spark, d):
    return table(spark, d, "part").select("p_partkey", text.key(F.concat_ws(" ", "p_brand", "p_type")).alias("key"))


@query("SF-23_relative_gap", """
    SELECT l_orderkey, l_linenumber, CASE WHEN p_retailprice <= 0 THEN 0 ELSE abs(l_extendedprice / l_quantity - p_retailprice) / p_retailprice END AS gap
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
def sf23(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", parse.gap(F.col("l_extendedprice") / F.col("l_quantity"), "p_retailprice").alias("gap"))


@query("SF-24_truncate", "SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE substr(s, 1, 57) || '...' END AS short FROM (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS s FROM documents)")
def sf24(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncated("text").alias("short"))


@query("SF-25_slugs", """
    WITH s AS (SELECT p_partkey, trim(substr(regexp_replace(lower(trim(regexp_replace(p_name || ' & ' || p_type, '[^\\p{L}\\p{N}_\\s-]', '', 'g'))), '[\\s_]+', '-', 'g'), 1, 48), '-') AS log,
        regexp_replace(replace(replace(lower(p_brand || '.com'), '.', ''), ' ', '_'), '[^a-z0-9_]+', '', 'g') AS site FROM part)
    SELECT p_partkey, CASE WHEN log = '' THEN 'query' ELSE log END AS log_slug, CASE WHEN site = '' THEN 'site' ELSE site END AS site_slug FROM s""")
def sf25(spark, d):
    return table(spark, d, "part").select("p_partkey", text.log_slug(F.concat_ws(" & ", "p_name", "p_type")).alias("log_slug"), text.site_slug(F.concat("p_brand", F.lit(".com"))).alias("site_slug"))


@query("SF-26_short_detail", "SELECT doc_id, CASE WHEN length(s) <= 160 THEN s ELSE substr(s, 1, 159) || '…' END AS detail FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)")
def sf26(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shortened("text").alias("detail"))


@query("SF-27_display", "SELECT p_partkey, '$' || format('{:,.2f}', CAST(p_retailprice AS DECIMAL(18,2))) AS price, format('{:,}', p_partkey) AS reviews, CASE WHEN p_name <> '' THEN 'Success' ELSE 'Failed' END AS status FROM part")
def sf27(spark, d):
    from ..operators import cascade

    p = table(spark, d, "part")
    return p.select("p_partkey", parse.shown_price(F.col("p_retailprice").cast("decimal(18,2)")).alias("price"), parse.shown_count("p_partkey").alias("reviews"), cascade.status("p_name", "p_retailprice").alias("status"))


JUNK = ["See options", "See all results here", "Shop now", "ILS66.93ILS66.93", "Typical: ILS 43.72 each", "$1,299.00", "USD 99.99 more", "Sony WH-1000XM5 Headphones", "short", "EUR 12,50  12 34", "  more   results  "]


_SF28 = (JUNK, "part", "p_partkey", "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'USD ' || p_size || '.99' WHEN 2 THEN p_name || '  ' || p_brand || ' ' || p_type ELSE 'Typical: USD ' || p_partkey END")


@query("SF-28_junk_title", f"""
    WITH t AS (SELECT i, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS t FROM {_sql_rows(*_SF28)})
    SELECT i, length(t) < 12 OR regexp_matches(t, '(?i)^\\s*(see\\s+options?|see\\s+all\\s+|shop\\s+now|more\\s+results|sponsored)\\s*$')
        OR regexp_matches(t, '(?i)^\\s*((ILS|USD|EUR|GBP|CAD|\\$|€|£)\\s*[0-9,.\\s]+|([0-9,]+\\.?[0-9]*)\\s*(ILS|USD|EUR|GBP|CAD))\\s*$')
        OR (regexp_matches(t, '(?i)(ILS|USD|EUR)\\s*[0-9,.]+') AND NOT regexp_matches(t, '(?i)[a-z]{{4,}}'))
        OR regexp_matches(t, '(?i)\\btypical:\\s*(ILS|USD)')
        OR ((length(t) - length(replace(t, 'ILS', ''))) / 3 >= 2 AND NOT regexp_matches(t, '(?i)headphone|bose')) AS junk FROM t""")
def sf28(spark, d):
    return _rows(spark, d, *_SF28).select("i", text.is_junk_title("s").alias("junk"))


@query("SF-29_condition_words", on_pairs(f"{DUCK_NON_NEW} AS non_new, {DUCK_USED} AS wants_used"))
def sf29(spark, d):
    return pairs(spark, d).select("pair_id", text.is_non_new("title").alias("non_new"), text.asks_for_used("query").alias("wants_used"))


@query("SF-30_visible_text")
def sf30(spark, d):
    from ..operators import html

    v = html.page_facts(table(spark, d, "pages"), ["page_id"])
    return v.select("page_id", F.substring("visible", 1, fixed.MAX_TEXT_CHARS).alias("visible"))


SITES = ["Amazon.com", "BestBuy.com", "Walmart.com", "Newegg.com", "Other.com"]


_SF31 = (SITES, "part", "p_partkey", "p_name || CASE WHEN p_size % 2 = 0 THEN '.com' ELSE '' END")


@query("SF-31_store_names", f"SELECT i, CASE s WHEN 'BestBuy.com' THEN 'Best Buy' ELSE replace(s, '.com', '') END AS store FROM {_sql_rows(*_SF31)}")
def sf31(spark, d):
    from ..streaming import progress

    return _rows(spark, d, *_SF31).select("i", progress.store("s").alias("store"))


UI = ["N/A", "$1,299.00", "4.7", "abc", ""]


_SF33 = (UI, "part", "p_partkey", "CASE WHEN p_size % 5 = 0 THEN 'N/A' ELSE '$' || p_partkey || ',' || lpad(CAST(p_size AS STRING), 3, '0') || '.25' END")


@query("SF-33_ui_number", f"SELECT i, TRY_CAST(regexp_replace(nullif(s, 'N/A'), '[$,]', '', 'g') AS DOUBLE) AS value FROM {_sql_rows(*_SF33)}")
def sf33(spark, d):
    return _rows(spark, d, *_SF33).select("i", parse.ui_number("s").alias("value"))


@query("SF-34_stars", "SELECT p_partkey, repeat('★', CAST(round(p_size % 6) AS BIGINT)) || repeat('☆', CAST(5 - p_size % 6 AS BIGINT)) AS stars FROM part")
def sf34(spark, d):
    return table(spark, d, "part").select("p_partkey", parse.stars((F.col("p_size") % 6).cast("double")).alias("stars"))


@query("SF-35_method_label", """
    WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'N/A' ELSE upper(event_type) END AS method, CASE event_id % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN '/p/' || event_id ELSE 'https://x.com/' || event_id END AS url FROM events)
    SELECT event_id, CASE WHEN method IS NULL OR method IN ('', 'N/A') THEN 'N/A' ELSE lower(method) END AS label, CASE WHEN url LIKE 'http%' THEN url END AS link FROM m""")
def sf35(spark, d):
    i, tail = F.col("event_id"), F.col("event_id").cast("string")
    method = F.when(i % 6 == 1, "").when(i % 6 == 2, "N/A").when(i % 6 > 2, F.upper("event_type"))
    url = F.when(i % 4 == 0, "N/A").when(i % 4 == 1, "").when(i % 4 == 2, F.concat(F.lit("/p/"), tail)).otherwise(F.concat(F.lit("https://x.com/"), tail))
    return table(spark, d, "events").select("event_id", parse.method_label(method).alias("label"), urls.product_link(url).alias("link"))


# URLs

PREFIXES = "[" + ", ".join(f"{{'w': '{w}', 'p': '{p}'}}" for _, w, _, p in fixed.RETAILERS) + "]"


@query("UR-01_search_url", f"SELECT p_partkey, s.w AS website, s.p || replace(url_encode(trim(p_name)), '%20', '+') AS search_url FROM part, (SELECT unnest({PREFIXES}) AS s)")
def ur01(spark, d):
    from ..sources import tables

    each = table(spark, d, "part").crossJoin(F.broadcast(tables.retailers(spark)))
    return each.select("p_partkey", "website", urls.search_url("search_prefix", "p_name").alias("search_url"))


URLS = [
    ("//www.bestbuy.com/site/a/6551465.p", "bestbuy.com"),
    ("http://www.newegg.com/p/3C6-0002-009C6", "newegg.com"),
    ("https://bestbuy.com/site/a-b-65inch-O2X-Pro/6551465.p?skuId=6551465#x", "bestbuy.com"),
    ("6551465", "bestbuy.com"),
    ("/site/sony-headphones/1234567", "bestbuy.com"),
    ("https://www.bestbuy.com/site/sony?skuId=1234567", "bestbuy.com"),
    ("https://www.bestbuy.com/product/abc/JJ8", "bestbuy.com"),
    ("https://www.bestbuy.com/site/searchpage.jsp?st=x", "bestbuy.com"),
    ("Item=N82E16834156463", "newegg.com"),
    ("/p/N82E16834156463?x=1", "newegg.com"),
    ("https://www.newegg.com/p/pl?d=macbook", "newegg.com"),
    ("https://www.newegg.com/laptop-sleeve/p/ABC-12345", "newegg.com"),
    ("https://www.newegg.com/Product.aspx?Item=N82E168", "newegg.com"),
    ("https://www.walmart.com/ip/tv/731473988?x=2", "walmart.com"),
    ("https://www.walmart.com/ip/tv/123456789", "walmart.com"),
    ("https://www.amazon.com/gp/product/B0CCZ1L489/ref=x", "amazon.com"),
    ("https://www.amazon.com/s?k=x", "amazon.com"),
    ("https://www.walmart.com/blocked?url=x", "walmart.com"),
    ("", "amazon.com"),
]
ROWS = [(i, *u) for i, u in enumerate(URLS)]


def url_rows(spark):
    return spark.createDataFrame(ROWS, "i int, url string, domain string")


U = values(ROWS, "i, url, domain")
HOST = "lower(regexp_extract({}, '^[a-z]+://([^/?#]*)', 1))"
PATH = "regexp_extract({}, '^(?:[a-z]+:)?(?://[^/?#]*)?([^?#]*)', 1)"


# examples, and the addresses of all pages
U_PAGES = f"(SELECT CAST(i AS INTEGER) AS i, url FROM {U} UNION ALL SELECT CAST(1000 + page_id AS INTEGER), url || CASE WHEN page_id % 5 = 0 THEN '/Blocked' ELSE '' END FROM pages)"


def _url_pages(spark, d):
    blocked = F.when(F.col("page_id") % 5 == 0, "/Blocked").otherwise("")
    return url_rows(spark).select("i", "url").unionByName(table(spark, d, "pages").select((F.col("page_id") + 1000).cast("int").alias("i"), F.concat("url", blocked).alias("url")))


@query("UR-02_normal_url", f"SELECT i, regexp_replace(regexp_replace(CASE WHEN url LIKE '//%' THEN 'https:' || url ELSE url END, '^http://(www\\.(?:bestbuy|newegg|amazon|walmart)\\.com)', 'https://\\1'), '^https?://bestbuy\\.com', 'https://www.bestbuy.com') AS url FROM {U_PAGES}")
def ur02(spark, d):
    return _url_pages(spark, d).select("i", urls.normal("url").alias("url"))


COERCED = {
    0: "https://www.bestbuy.com/site/a/6551465.p", 1: "https://www.newegg.com/p/3C6-0002-009C6", 2: "https://www.bestbuy.com/site/a-b-65inch-O2X-Pro/6551465.p?skuId=6551465",
    3: "https://www.bestbuy.com/site/product/6551465.p", 4: "https://www.bestbuy.com/site/sony-headphones/1234567.p", 5: "https://www.bestbuy.com/site/sony/1234567.p",
    8: "https://www.newegg.com/Product.aspx?Item=N82E16834156463", 9: "https://www.newegg.com/p/N82E16834156463?x=1",
}


@query("UR-03_coerce_url", expect([(i, COERCED.get(i, u)) for i, u, _ in ROWS], "i, url"))
def ur03(spark, d):
    return urls.coerced(url_rows(spark)).select("i", "url")


@query("UR-05_same_domain", f"SELECT i, contains({HOST.format('url')}, domain) AS same FROM {values([r for r in ROWS if r[1].startswith('http')], 'i, url, domain')}")
def ur05(spark, d):
    return url_rows(spark).where("url LIKE 'http%'").select("i", urls.same_domain("url", "domain").alias("same"))


@query("UR-06_newegg_segment", f"""
    WITH u AS (SELECT i, url, {PATH.format('url')} AS p FROM {U} WHERE domain = 'newegg.com' AND url LIKE 'http%')
    SELECT i, CASE WHEN lower(p) LIKE '%/p/pl' OR lower(p) LIKE '%/p/pl/%' THEN NULL ELSE coalesce(nullif(CASE WHEN lower(regexp_extract(p, '(?i)/p/([A-Z0-9][A-Z0-9-]{{3,}})', 1)) <> 'pls' THEN regexp_extract(p, '(?i)/p/([A-Z0-9][A-Z0-9-]{{3,}})', 1) END, ''),
        nullif(regexp_extract(split_part(url, '?', 2), '(?i)item=([A-Z0-9-]{{6,}})', 1), '')) END AS segment FROM u""")
def ur06(spark, d):
    return url_rows(spark).where("domain = 'newegg.com' AND url LIKE 'http%'").select("i", urls.newegg_segment("url").alias("segment"))


@query("UR-07_title_from_url", expect([(0, "A"), (2, "A B 65Inch O2X Pro"), (3, "Best Buy SKU 6551465"), (4, "Sony Headphones"), (5, "Sony"), (6, "Abc"), (7, "Searchpage.Jsp")], "i, title"))
def ur07(spark, d):
    return url_rows(spark).where("domain = 'bestbuy.com'").select("i", urls.bestbuy_title(urls.canonical("url")).alias("title"))


@query("UR-08_canonical_url", "SELECT page_id, regexp_replace(split_part(split_part(url || '/?q=1#top', '?', 1), '#', 1), '/+$', '') AS canonical FROM pages")
def ur08(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.concat("url", F.lit("/?q=1#top"))).alias("canonical"))


@query("UR-09_asin_membership", f"SELECT i, list_contains(list_transform(regexp_extract_all(url, '(?i)/(?:dp|gp/product)/([A-Z0-9]{{10}})', 1), lambda x: upper(x)), 'B0CCZ1L489') AS has FROM {U}")
def ur09(spark, d):
    return url_rows(spark).select("i", urls.has_asin("url", F.lit("b0ccz1l489")).alias("has"))


@query("UR-10_block_page", f"SELECT i, regexp_matches(lower(url), '/blocked|validatecaptcha|/bot-mitigation') AS blocked FROM {U_PAGES}")
def ur10(spark, d):
    return _url_pages(spark, d).select("i", urls.is_block_page("url").alias("blocked"))
