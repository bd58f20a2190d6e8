"""Filters (FL) and similar conditions over pairs, pages and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, fuzzy, parse, urls
from ..operators import cascade, filters
from .common import DUCK_PAIRS, array, duck_any, expect, formed_pairs, on_pairs, query, table, values
from .scalars import DUCK_CHIPS, DUCK_CODES, DUCK_NON_NEW, DUCK_SETS, DUCK_USED, PATH, ROWS, U, duck_inches, duck_series, texts, url_rows

MAC = r"^(refurbished\s+)?apple\s+macbook"
DOCK = r"\b(usb c hub|docking station|hub adapter)\b"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


DEVICE = duck_any("q", fixed.DEVICE_WORDS)
PERIPHERAL = rf"""({DEVICE} AND {duck_any('head', fixed.PERIPHERAL_WORDS)} AND NOT {has('t', MAC + r'\s+(pro|air)\b')}
    AND CASE WHEN {has('head', r'\bmacbook\s+(air|pro)\s+charger\b')} THEN TRUE
        WHEN {has('head', r'\b(charger|power adapter|charging adapter)\b')} THEN NOT ({has('head', r'\b[0-9]{1,2}\s*inch\b')} AND {has('head', r'\b([0-9]+\s*gb|[0-9]+\s*tb|ssd|m[1-9]\s+chip)\b')})
        ELSE {has('head', DOCK)} AND NOT {has('head', MAC)} END)"""
NEW_PHRASE = f"(len(list_filter({array(fixed.ACCESSORY_PHRASES)}, lambda x: contains(t, x) AND NOT contains(q, x))) > 0)"
ACCESSORY = rf"""({PERIPHERAL}
    OR ({DEVICE} AND NOT contains(q, 'case') AND (({has('head', r'\b(case|cover|folio|shell|sleeve)\b')} AND NOT {has('head', MAC + r'\s+(pro|air)\b')}) OR ({has('head', DOCK)} AND NOT {has('head', MAC)})))
    OR (({has('q', r'\bapple\s+macbook\b')} OR (contains(q, 'macbook') AND contains(q, 'apple'))) AND NOT {has("left(split_part(t, 'compatible with', 1), 100)", r'\b(apple|macbook)\b')})
    OR {NEW_PHRASE}
    OR (contains(t, 'keyboard') AND contains(t, 'case') AND NOT contains(q, 'keyboard') AND NOT contains(q, 'case')))"""
BUDS, OVER = duck_any("t", fixed.EARBUD_WORDS), duck_any("t", fixed.OVER_EAR_WORDS)
WANTS_PHONES, WANTS_BUDS = "(contains(q, 'headphone') AND NOT contains(q, 'earbud'))", "(contains(q, 'earbud') AND NOT contains(q, 'headphone'))"
EARBUDS = f"(({WANTS_PHONES} AND {BUDS} AND NOT {OVER}) OR ({WANTS_BUDS} AND {OVER} AND NOT {BUDS}))"
BUNDLE = f"(NOT {duck_any('q', fixed.BUNDLE_QUERY_WORDS)} AND {duck_any(chr(40) + 't || chr(32) || lower(url)' + chr(41), fixed.BUNDLE_MARKERS)})"
CODE = f"(len(list_filter({DUCK_CODES}, lambda c: NOT contains(t, c))) > 0)"
QC, TC = DUCK_CHIPS.format("q"), DUCK_CHIPS.format("t")
CHIP = f"coalesce(list_max({TC}) < list_max({QC}) OR (len({TC}) >= 2 AND list_min({TC}) < list_max({QC})), FALSE)"
QS, TS = duck_inches("q", "array_to_string(qm, ' ')"), duck_inches("t", "url")
SIZE = f"(len({QS}) > 0 AND len({TS}) > 0 AND NOT list_has_any({QS}, {TS}))"
YEAR = "(len(qy) > 0 AND len(ty) > 0 AND NOT coalesce(list_contains(ty, qy[1]), FALSE))"
FIRST = "list_filter(string_split(q, ' '), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+'))[1]"
SERIES = rf"""(coalesce(list_contains(string_split(t, ' '), {FIRST}), FALSE) AND len(list_filter({duck_series('q')}, lambda x: NOT list_contains({duck_series('t')}, x))) > 0
    AND (len({duck_series('t')}) > 0 OR {has('t', fixed.VARIANT_WORD)}))"""
MODEL = f"({CODE} OR {SERIES} OR {CHIP} OR {SIZE} OR {BUNDLE})"


def on(name: str, sql: str, column):
    """A query over pairs with one boolean column."""

    @query(name, on_pairs(f"{sql} AS fires"))
    def run(spark, d):
        return formed_pairs(spark, d).select("pair_id", column().alias("fires"))


Q, T = (lambda: F.col("query_form")), (lambda: F.col("title_form"))
on("FL-01_peripheral", PERIPHERAL, lambda: filters.peripheral(Q(), T()))
on("FL-02_accessory", ACCESSORY, lambda: filters.accessory(Q(), T()))
on("FL-03_earbuds_vs_headphones", EARBUDS, lambda: filters.earbuds_vs_headphones(Q(), T()))
on("FL-04_known_earbuds", f"({WANTS_PHONES} AND upper(regexp_extract(url, '(?i)/dp/([A-Z0-9]{{10}})', 1)) IN ('B0D6WCQWJS', 'B0D6WBKCPD'))", lambda: filters.known_earbuds(Q(), "url"))
on("FL-05_bundle", BUNDLE, lambda: filters.bundle(Q(), T(), "url"))
on("FL-06_model_code", CODE, lambda: filters.model_code(Q(), T()))
on("FL-07_chip_generation", CHIP, lambda: filters.chip_generation(Q(), T()))
on("FL-08_screen_size", SIZE, lambda: filters.screen_size(Q(), T(), "url"))
on("FL-09_year", YEAR, lambda: filters.year(Q(), T()))
on("FL-10_numeric_series", SERIES, lambda: filters.numeric_series(Q(), T()))
on("FL-11_model_mismatch", MODEL, lambda: filters.model(Q(), T(), "url"))
on("FL-12_skip_candidate", f"(NOT {DUCK_USED} AND ({DUCK_NON_NEW} OR {BUNDLE}))", lambda: filters.skip_candidate("query", Q(), "title", T(), "url"))


@query("FL-13_drop_accessories", f"""
    WITH {'{pairs}'}, g AS (SELECT pair_id, query, {ACCESSORY} AS acc, {DEVICE} AS device FROM p),
    c AS (SELECT *, count(*) FILTER (NOT acc) OVER (PARTITION BY query) AS kept FROM g)
    SELECT pair_id FROM c WHERE NOT acc OR (kept = 0 AND NOT device)""".replace("{pairs}", "%PAIRS%"))
def fl13(spark, d):
    return filters.drop_accessories(formed_pairs(spark, d), ["query"]).select("pair_id")


@query("FL-14_ram_kit", r"""
    SELECT page_id, regexp_matches(lower(url), 'apple-mac(book|-mini)-memory') AND regexp_matches(lower(html), 'macbook (pro|air)') AS conflict FROM pages""")
def fl14(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", filters.ram_kit("url", "html").alias("conflict"))


@query("FL-15_bot_page", f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(fixed.BOT_PATTERNS)}') AS blocked FROM documents")
def fl15(spark, d):
    return table(spark, d, "documents").select("doc_id", filters.bot_page("text").alias("blocked"))


@query("FL-17_product_url", expect([(i, i in (0, 1, 2, 6, 11, 12, 13, 14, 15)) for i, _, _ in ROWS], "i, product"))
def fl17(spark, d):
    return url_rows(spark).select("i", urls.is_product("url", "domain").alias("product"))


ITEMS = ["12345678", "111111111", "123456789", "731473988", "1234567890", "345678901", "5678901234", "x", "987654321012"]


@query("FL-18_made_up_item", f"""
    SELECT i, NOT regexp_full_match(s, '[0-9]+') OR length(s) < 9 OR len(list_distinct(string_split(s, ''))) = 1 OR s IN ('12345678', '123456789', '1234567890', '0123456789')
        OR (length(s) <= 10 AND s = array_to_string(list_transform(range(0, length(s)), lambda k: CAST((TRY_CAST(substr(s, 1, 1) AS BIGINT) + k) % 10 AS VARCHAR)), '')) AS made_up FROM {values(texts(ITEMS), 'i, s')}""")
def fl18(spark, d):
    return spark.createDataFrame(texts(ITEMS), "i int, s string").select("i", urls.made_up_item("s").alias("made_up"))


@query("FL-19_accessory_slug", f"SELECT i, {duck_any(f'lower({PATH.format(chr(117) + chr(114) + chr(108))})', fixed.ACCESSORY_SLUGS)} AS accessory FROM {values([r for r in ROWS if r[1].startswith('http')], 'i, url, domain')}")
def fl19(spark, d):
    return url_rows(spark).where("url LIKE 'http%'").select("i", urls.accessory_slug("url").alias("accessory"))


@query("FL-20_validate_fields", """
    SELECT p_partkey, CASE WHEN p_name IS NULL OR length(trim(p_name)) < 3 THEN 'missing or too-short title'
        WHEN lower(trim(p_name)) IN ('amazon.com', 'best buy', 'walmart.com', 'newegg.com', 'access denied') THEN 'generic page title'
        WHEN p_retailprice IS NULL THEN 'missing price' WHEN p_retailprice - 950 <= 0 THEN 'nonsensical price'
        WHEN p_size % 8 > 5 THEN 'rating out of range' WHEN p_size - 5 < 0 THEN 'negative review count' END AS reject_reason FROM part""")
def fl20(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", parse.reject_reason("p_name", F.col("p_retailprice") - 950, F.col("p_size") % 8, F.col("p_size") - 5).alias("reject_reason"))


CONTEXTS = ["corePrice_feature_div a-section", "coupon_feature a-box", "a-box monthly", "warranty-row", "tradeInBlock trade-in", ""]
TEASERS = ["$89/mo", "$1,599.00", "$49.99 per month", "monthly payments", "monthly from $12", "$5 a month"]


@query("FL-21_add_on_context", f"SELECT i, {duck_any('lower(s)', fixed.ADD_ON_WORDS)} AS in_addon FROM {values(texts(CONTEXTS), 'i, s')}")
def fl21(spark, d):
    return spark.createDataFrame(texts(CONTEXTS), "i int, s string").select("i", filters.add_on("s").alias("in_addon"))


@query("FL-22_financing_teaser", f"SELECT i, regexp_matches(replace(lower(s), ' ', ''), '/mo|/month|permonth|amonth') OR (contains(lower(s), 'monthly') AND regexp_matches(s, '[0-9]')) AS teaser FROM {values(texts(TEASERS), 'i, s')}")
def fl22(spark, d):
    return spark.createDataFrame(texts(TEASERS), "i int, s string").select("i", filters.financing("s").alias("teaser"))


LOW = [(0, "Apple MacBook Pro 14", 399.0), (1, "Apple MacBook Pro 14", 1599.0), (2, "LG 65 inch OLED evo", 299.0), (3, "LG OLED evo", 99.0), (4, "Lenovo Tab", 5.0), (5, "LG 65-inch class OLED", 1299.0)]


@query("FL-23_implausibly_low", rf"""
    SELECT i, (regexp_matches(title, '(?i)macbook\s+(pro|air)\b') AND price < 400) OR (regexp_matches(title, '(?i)(\boled\b|\bclass\s+oled\b|oled\s*evo)') AND regexp_matches(title, '(?i)\b[0-9]{{2}}\s*-?\s*inch\b') AND price < 300) AS low
    FROM {values(LOW, 'i, title, price')}""")
def fl23(spark, d):
    return spark.createDataFrame(LOW, "i int, title string, price double").select("i", filters.implausibly_low("title", "price").alias("low"))


@query("FL-24_has_price", "SELECT o_orderkey, o_orderstatus <> 'F' AND o_totalprice IS NOT NULL AS has_price FROM orders")
def fl24(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", "Success").otherwise("Failed").alias("status"), F.col("o_totalprice").alias("price"))
    return o.select("o_orderkey", cascade.has_price().alias("has_price"))


@query("FL-25_unscored_sanity", f"WITH RECURSIVE {DUCK_PAIRS}, {DUCK_SETS} SELECT pair_id, (trim(title) <> trim(query) AND token_set < 30) OR (NOT {DUCK_USED} AND {DUCK_NON_NEW}) AS refused FROM p JOIN alike USING (pair_id)")
def fl25(spark, d):
    p = formed_pairs(spark, d)
    return p.select("pair_id", cascade.unscored_sanity("query", "query", "title", fuzzy.similarity("token_set", "query_form.normalized", "title_form.normalized")).alias("refused"))


@query("FL-26_accept_discovered", on_pairs(f"(url LIKE 'http%' AND lower(title) <> q AND NOT {MODEL} AND NOT {ACCESSORY}) AS accepted"))
def fl26(spark, d):
    p = formed_pairs(spark, d)
    ok = urls.reachable("url", F.lit(200)) & (F.lower("title") != F.col("query_form.normalized")) & ~filters.model(Q(), T(), "url") & ~filters.accessory(Q(), T())
    return p.select("pair_id", ok.alias("accepted"))


@query("CA-07_recheck", on_pairs(f"CASE WHEN {ACCESSORY} OR {MODEL} THEN 'Failed' ELSE 'Success' END AS status"))
def ca07(spark, d):
    return cascade.rechecked(formed_pairs(spark, d).withColumn("status", F.lit("Success"))).select("pair_id", "status")


def _fill() -> None:
    from .common import DUCK_PAIRS, ORACLE_SQL

    ORACLE_SQL["FL-13_drop_accessories"] = ORACLE_SQL["FL-13_drop_accessories"].replace("%PAIRS%", DUCK_PAIRS)


_fill()
