"""Joins (JN), aggregates (AG), windows and order (WN, SO), sets (ST), stateful pieces in batch (SS), judgements (UD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import cascade, html, judge, matching, similarity
from ..plans import comparison
from ..sources import tables
from ..streaming import progress
from .common import duck_norm, query, table, values
from .scalars import DUCK_LCS, DUCK_SETS

# Retailers for SQL.
SITES = values([(0, "Amazon.com"), (1, "BestBuy.com"), (2, "Walmart.com"), (3, "Newegg.com")], "site_order, website")
SITE_OF = "(l_suppkey % 4)"


def _site(c):
    return F.element_at(F.array(*(F.lit(s) for s in ("Amazon.com", "BestBuy.com", "Walmart.com", "Newegg.com"))), (F.col(c) % 4 + 1).cast("int"))


@query("JN-01_fan_out", f"SELECT o_orderkey AS query_id, website, CAST(site_order AS INTEGER) AS site_order FROM orders CROSS JOIN {SITES}")
def jn01(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"))
    return q.crossJoin(F.broadcast(tables.retailers(spark))).select("query_id", "website", "site_order")


@query("JN-02_plan_default", f"""
    SELECT p_partkey AS query_id, s.website, coalesce(l.search, p_name) AS search_query, coalesce(l.search, p_name) AS match_query
    FROM part CROSS JOIN {SITES} s LEFT JOIN (SELECT DISTINCT s_suppkey AS k, 'Walmart.com' AS website, s_name AS search FROM supplier) l ON l.k = p_partkey AND l.website = s.website""")
def jn02(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("user_query"))
    plans = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.lit("Walmart.com").alias("website"), F.col("s_name").alias("search_query"), F.col("s_name").alias("match_query"))
    return cascade.planned(q, tables.retailers(spark), plans).select("query_id", "website", "search_query", "match_query")


@query("JN-03_listings_of_query", """
    SELECT l_orderkey AS query_id, l_linenumber AS rank, p_name AS title FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
    WHERE NOT contains(p_name, 'new') AND o_orderstatus <> 'F'""")
def jn03(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("p_partkey"))
    listings = rows.join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title")), "p_partkey")
    q = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("query_id"))
    return matching.listings_of(listings, q, ["query_id"], ~F.contains("title", F.lit("new"))).select("query_id", "rank", "title")


SIMILAR = 90.0
TITLES = f"titles AS (SELECT q, count(*) AS n FROM (SELECT {duck_norm("p_name || ' ' || p_brand || ' ' || p_type")} AS q FROM part) GROUP BY q)"
KINDS = f"titles AS (SELECT q, count(*) AS n FROM (SELECT {duck_norm("p_name || ' ' || p_type")} AS q FROM part) GROUP BY q)"
# a distance with substitutions is no larger than one without; it leaves few pairs for the exact measure
ALL_PAIRS = "pairs AS (SELECT CAST(row_number() OVER () AS BIGINT) AS pair_id, x.q, y.q AS t, x.n AS parts_a, y.n AS parts_b FROM titles x JOIN titles y ON x.q < y.q {})"


def _similar(spark, d, columns, measure):
    """Similar pairs of distinct texts made from ``part``, with the number of parts that have each."""
    rows = table(spark, d, "part").select(text.normalized(F.concat_ws(" ", *columns)).alias("text"))
    n = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    pairs = similarity.similar_pairs(rows, "text", measure, SIMILAR)
    for side in "ab":
        pairs = pairs.join(n.select(F.col("text").alias(side), F.col("n").alias(f"parts_{side}")), side)
    return pairs.select("a", "b", "score", "parts_a", "parts_b")


@query("JN-03_similar_titles", f"""
    WITH RECURSIVE {TITLES}, {ALL_PAIRS.format("WHERE 10 * levenshtein(x.q, y.q) <= length(x.q) + length(y.q)")},
    texts AS (SELECT pair_id, q AS a, t AS b FROM pairs), {DUCK_LCS}
    SELECT s.a, s.b, 200.0 * best[len(best)] / (length(s.a) + length(s.b)) AS score, parts_a, parts_b FROM steps s JOIN pairs USING (pair_id)
    WHERE i = length(s.a) AND 200 * best[len(best)] >= {SIMILAR} * (length(s.a) + length(s.b))""")
def jn03_similar(spark, d):
    return _similar(spark, d, ["p_name", "p_brand", "p_type"], "ratio")


@query("JN-03_alike_words", f"""
    WITH RECURSIVE {KINDS}, {ALL_PAIRS.format("")}, p AS (SELECT pair_id, q, t FROM pairs), {DUCK_SETS}
    SELECT q AS a, t AS b, token_set AS score, parts_a, parts_b FROM alike JOIN pairs USING (pair_id) WHERE token_set >= {SIMILAR}""")
def jn03_alike(spark, d):
    return _similar(spark, d, ["p_name", "p_type"], "token_set")


GAPS = """
    SELECT l_orderkey AS query_id, l_linenumber, l_extendedprice / l_quantity AS price, p_retailprice AS ref_price,
        abs(l_extendedprice / l_quantity - p_retailprice) / p_retailprice AS gap
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_retailprice > 0 AND l_extendedprice / l_quantity > 0"""


@query("JN-04_price_gap_join", f"SELECT query_id, l_linenumber, gap FROM ({GAPS}) WHERE gap > 0.2")
def jn04(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    ref = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("ref_price"))
    return cascade.gap_outliers(rows, ref, 0.2, ["l_partkey"]).select("query_id", "l_linenumber", "gap")


@query("JN-05_not_tried", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def jn05(spark, d):
    tried = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return cascade.not_tried(table(spark, d, "part"), tried, ["p_partkey"]).select("p_partkey")


@query("JN-06_known_page", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def jn06(spark, d):
    address = lambda c, rest="": F.concat(F.lit("https://www.amazon.com/dp/"), F.col(c).cast("string"), F.lit(rest))
    known = table(spark, d, "nation").where("n_regionkey = 2").select(address("n_nationkey").alias("url"))
    rows = table(spark, d, "customer").select("c_custkey", F.replace(address("c_nationkey", "?ref=1"), F.lit("dp"), F.lit("DP")).alias("url"))
    return tables.in_catalogue(rows, known).select("c_custkey")


@query("JN-07_score_by_url", "SELECT p_partkey, coalesce(s, 0.0) AS score FROM part LEFT JOIN (SELECT l_partkey, min_by(l_discount, l_orderkey * 10 + l_linenumber) AS s FROM lineitem WHERE l_tax > 0.05 GROUP BY 1) ON l_partkey = p_partkey")
def jn07(spark, d):
    scored = table(spark, d, "lineitem").where("l_tax > 0.05").select(F.col("l_partkey").alias("p_partkey"), F.col("l_discount").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return matching.with_scores(table(spark, d, "part").select("p_partkey"), scored, ["p_partkey"], F.col("at"))


KNOWN_QUERIES = [(1, "Lenovo Tab P12"), (2, "MacBook Pro M5"), (3, "macbook pro 14"), (4, "Bose QuietComfort Ultra"), (5, "QC Ultra"), (6, "LG OLED65C4PUA"), (7, "toaster"), (8, "  ")]


@query("JN-08_catalogue", f"""
    WITH k AS (SELECT * FROM {values([(r[0], r[1], r[2], r[4]) for r in tables.KNOWN_PAGES], 'domain, inc, exc, url')})
    SELECT CAST(query_id AS INTEGER) AS query_id, domain, url FROM {values(KNOWN_QUERIES, 'query_id, q')} JOIN k ON regexp_matches(lower(trim(q)), inc) AND (exc IS NULL OR NOT regexp_matches(lower(q), exc))""")
def jn08(spark, d):
    q = tables.asked(spark.createDataFrame(KNOWN_QUERIES, "query_id int, user_query string"))
    return tables.catalogued(q).select("query_id", "domain", "url")


@query("JN-09_site_order", f"SELECT s_suppkey, coalesce(site_order, 99) AS site_order FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Amazon.com' WHEN 1 THEN 'BestBuy.com' WHEN 2 THEN 'Walmart.com' WHEN 3 THEN 'Newegg.com' ELSE 'Other' END AS w FROM supplier) LEFT JOIN {SITES} ON website = w")
def jn09(spark, d):
    names = F.element_at(F.array(*(F.lit(s) for s in ("Amazon.com", "BestBuy.com", "Walmart.com", "Newegg.com", "Other"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s = table(spark, d, "supplier").select("s_suppkey", names.alias("website"))
    return cascade.with_site_order(s, tables.retailers(spark)).select("s_suppkey", "site_order")


@query("JN-10_judged", "SELECT d.doc_id, coalesce(l.quality = 1, TRUE) AS match, l.doc_id IS NOT NULL AS verified FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jn10(spark, d):
    title = F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select("doc_id", F.lit("a document").alias("expected"), title.alias("scraped"))
    verdicts = table(spark, d, "labels").select(F.lit("a document").alias("expected"), title.alias("scraped"), (F.col("quality") == 1).alias("match"))
    return judge.titles(rows, verdicts).select("doc_id", "match", "verified")


# aggregates


@query("AG-01_success_count", "SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS n, count(*) AS total, count(*) FILTER (l_returnflag <> 'N') >= 3 AS ok FROM lineitem GROUP BY 1")
def ag01(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", "Success").otherwise("Failed").alias("status"), F.col("l_extendedprice").alias("price"))
    return cascade.enough_prices(rows, ["l_orderkey"]).select("l_orderkey", F.col("success_count").alias("n"), F.col("total_sites").alias("total"), "ok")


@query("AG-02_region_prices", "SELECT l_orderkey, l_linestatus AS region, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2")
def ag02(spark, d):
    prices = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("region"), F.col("l_extendedprice").alias("price"))
    return html.region_prices(prices, ["l_orderkey"])


@query("AG-03_first_success", "SELECT user_id, min_by(value, event_id) AS price, min(event_id) AS stage FROM events WHERE value >= 10 GROUP BY 1")
def ag03(spark, d):
    staged = table(spark, d, "events").select("user_id", F.col("event_id").alias("stage"), F.col("value").alias("price"), F.when(F.col("value") < 10, "low").alias("reject_reason"))
    return cascade.first_success(staged, ["user_id"])


@query("AG-04_first_cause", "SELECT event_type AS component, min_by(CAST(user_id AS VARCHAR), event_id) AS cause FROM events GROUP BY 1")
def ag04(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("component"), F.col("user_id").cast("string").alias("cause"))
    return judge.degradations(log).select("component", "cause")


@query("AG-06_distinct_in_order", "WITH f AS (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS kinds FROM f GROUP BY 1")
def ag06(spark, d):
    listed = matching.distinct_in_order(table(spark, d, "events"), ["user_id"], "event_type", "event_id")
    return listed.select("user_id", F.array_join("event_type", ",").alias("kinds"))


RUNNING = """
    SELECT conv_id AS job_id, turn AS seq, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS done, role FROM conversations"""


@query("AG-07_percent", f"SELECT job_id, seq, done, CAST(greatest(0, least(100, CASE role WHEN 'assistant' THEN 10 + done * 70 // 4 WHEN 'user' THEN 5 + done * 70 // 4 ELSE 0 END)) AS INTEGER) AS percent FROM ({RUNNING})")
def ag07(spark, d):
    kind = F.when(F.col("role") == "assistant", "site_finished").when(F.col("role") == "user", "site_started").otherwise("start")
    e = table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), kind.alias("kind"))
    return progress.progress(e).select("job_id", "seq", "done", "percent")


@query("AG-08_response", "SELECT user_id AS query_id, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS rows, count(*) FILTER (event_type <> 'view') AS success_count, count(*) AS total_sites FROM events GROUP BY 1")
def ag08(spark, d):
    status = F.when(F.col("event_type") != "view", "Success").otherwise("Failed")
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("site_order"), F.col("event_type").alias("website"), F.lit("t").alias("title"), F.col("value").alias("price"),
        F.lit(None).cast("double").alias("average_rating"), F.lit(None).cast("bigint").alias("review_count"), status.alias("status"), F.lit("http").alias("method"),
    )
    r = cascade.responses(rows)
    return r.select("query_id", F.array_join(F.transform("rows", lambda x: F.concat_ws(":", x["site_order"].cast("string"), x["website"])), ",").alias("rows"), "success_count", "total_sites")


@query("AG-09_joined_names", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def ag09(spark, d):
    return progress.joined_names(table(spark, d, "nation"), ["n_regionkey"], "n_name", "n_nationkey")


# windows and order


@query("WN-01_running_rank", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rank FROM lineitem WHERE l_quantity > 5 QUALIFY rank <= 15")
def wn01(spark, d):
    return matching.serp_rank(table(spark, d, "lineitem").where("l_quantity > 5"), ["l_orderkey"], ["l_linenumber"]).select("l_orderkey", "l_linenumber", "rank")


@query("WN-02_source_rank", "SELECT doc_id, CAST(i AS INTEGER) AS rank, word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word)")
def wn02(spark, d):
    return matching.source_rank(table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words")), "words", "word")


@query("WN-03_keep_first", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def wn03(spark, d):
    return matching.keep_first(table(spark, d, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_linenumber")


SCORED = "SELECT user_id, event_id, round(value % 60, 6) AS score, event_id AS rank, CAST(event_id % 100 AS DOUBLE) AS recall, CAST(event_id % 70 AS DOUBLE) AS ts, event_type FROM events"


def scored(spark, d):
    recall, token_set = (F.col("event_id") % 100).cast("double"), (F.col("event_id") % 70).cast("double")
    return table(spark, d, "events").select(
        "user_id", "event_id", F.round(F.col("value") % 60, 6).alias("score"), F.col("event_id").alias("rank"), F.lit("").alias("url"), F.lit(False).alias("fallback"),
        recall.alias("model_recall"), token_set.alias("token_set"), "event_type",
    )


@query("WN-04_candidate_order", f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rank) AS place FROM ({SCORED})")
def wn04(spark, d):
    return matching.ranked(scored(spark, d), ["user_id"]).select("user_id", "event_id", "place")


@query("WN-05_best_match", f"""
    WITH b AS (SELECT * FROM ({SCORED}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rank) = 1)
    SELECT user_id, event_id, CASE WHEN score >= 48 THEN 'score' WHEN score >= 42 AND recall >= 55 THEN 'soft' ELSE 'model' END AS tier
    FROM b WHERE score >= 48 OR (score >= 42 AND recall >= 55) OR (recall >= 50 AND ts >= 45)""")
def wn05(spark, d):
    return matching.best_match(scored(spark, d), ["user_id"]).select("user_id", "event_id", "tier")


PLACED = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rank) AS place FROM ({SCORED})"


@query("WN-07_first_valid", f"""
    WITH c AS (SELECT *, count(*) FILTER (event_type <> 'view') OVER (PARTITION BY user_id ORDER BY place) AS checks FROM ({PLACED}))
    SELECT user_id, event_id FROM c WHERE checks <= 2 AND event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place) = 1""")
def wn07(spark, d):
    o = matching.ranked(scored(spark, d), ["user_id"])
    return matching.first_valid(o, F.col("event_type") == "click", F.col("event_type") != "view", ["user_id"], 2).select("user_id", "event_id")


@query("WN-08_alternates", f"""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS attempt FROM ({PLACED}) WHERE place > 1 AND event_type <> 'view')
    SELECT user_id, min_by(event_id, attempt) AS event_id FROM a WHERE attempt <= 5 AND recall > 30 GROUP BY 1""")
def wn08(spark, d):
    o = matching.ranked(scored(spark, d), ["user_id"]).where("place > 1 AND event_type <> 'view'")
    return matching.first_valid(o, F.col("model_recall") > 30.0, F.lit(True), ["user_id"], fixed.MAX_ATTEMPTS).select("user_id", "event_id")


@query("WN-09_safe_pick", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def wn09(spark, d):
    """Each order is a page and each of its lines a listing of the same title; returned ones were refused."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") != "R").alias("match"))
    rows = rows.withColumns({"query": F.lit("desk lamp"), "title": F.lit("Desk lamp, black"), "url": F.lit("https://www.amazon.com/dp/B0AAAAAAA1")})
    listings = rows.withColumn("query_form", text.normal_form("query")).withColumn("title_form", text.normal_form("title"))
    return cascade.safe_pick(listings, ["l_orderkey"]).select("l_orderkey", F.col("rank").alias("l_linenumber"))


@query("WN-10_serp_limit", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 15")
def wn10(spark, d):
    return matching.serp_rank(table(spark, d, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("WN-11_refinements", "WITH f AS (SELECT user_id, lower(event_type) AS s, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, s AS search FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen) <= 2")
def wn11(spark, d):
    """Each user is a query and each event a verdict on a listing of its page that says what to search for instead."""
    said = table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), F.lit("Amazon.com").alias("website"), F.lit(comparison.SERP).alias("source"), F.lit(1).alias("stage"), F.col("event_id").alias("place"), F.lit(False).alias("gone"),
        F.lit(False).alias("skip"), F.lit(False).alias("match"), judge.suggested(F.lit("refine_search"), F.lower("event_type"), F.lit("")).alias("suggestion"),
    )
    looks = matching.picked(said, comparison.PAGE, "place", ["place"], most=1 << 30)
    return comparison.refinements(looks).select(F.col("query_id").alias("user_id"), "search")


@query("SO-01_output_order", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(nullif(s_suppkey % 5, 4), 99), s_suppkey) AS place FROM supplier")
def so01(spark, d):
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.nullif(F.col("s_suppkey") % 5, F.lit(4)).alias("site_order"), F.col("s_suppkey").alias("tie"))
    return cascade.output_order(rows, ["s_nationkey"]).select("s_suppkey", "place")


@query("SO-02_nulls_last", """
    WITH x AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 7 END AS v FROM nation)
    SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY v ASC NULLS LAST, n_nationkey) AS up, row_number() OVER (PARTITION BY n_regionkey ORDER BY v DESC NULLS LAST, n_nationkey) AS down FROM x""")
def so02(spark, d):
    n = table(spark, d, "nation").withColumn("v", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey") % 7))
    place = lambda descending: cascade.display_order("v", ["n_regionkey"], "n_nationkey", descending)
    return n.select("n_nationkey", place(False).alias("up"), place(True).alias("down"))


LOG = [(3, "price verify", "timeout"), (1, "title verify", "no key"), (5, "title verify", "quota"), (4, "search plan", "no key"), (9, "other", "x")]


@query("SO-03_degradation_order", f"""
    WITH c AS (SELECT component, min_by(cause, seq) AS cause FROM {values(LOG, 'seq, component, cause')} GROUP BY 1), o AS (SELECT * FROM {values([(i, c) for i, c, _ in fixed.COMPONENTS], 'k, component')})
    SELECT component, cause, coalesce(k, 6) AS component_order FROM c LEFT JOIN o USING (component)""")
def so03(spark, d):
    return judge.degradations(spark.createDataFrame(LOG, "seq bigint, component string, cause string")).select("component", "cause", "component_order")


# sets


@query("ST-01_ordered_union", "WITH f AS (SELECT conv_id, lower(trim(role)) AS k, min_by(trim(role), turn) AS spelled, min(turn) AS seen FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(spelled, '|' ORDER BY seen) AS searches FROM f GROUP BY 1")
def st01(spark, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(listed.alias("roles"))
    return rows.select("conv_id", F.array_join(tables.distinct_strings(F.col("roles")), "|").alias("searches"))


@query("ST-02_gated_union", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END = min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey)")
def st02(spark, d):
    rows = table(spark, d, "lineitem").withColumn("stage", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2))
    return cascade.first_stage(rows, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("ST-03_array_overlap", "WITH e AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1) SELECT user_id, list_has_any(kinds, ['click', 'purchase']) AS hit, CAST(len(list_intersect(kinds, ['click', 'view'])) AS INTEGER) AS both FROM e")
def st03(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    lit = lambda *v: F.array(*map(F.lit, v))
    return e.select("user_id", text.overlap("kinds", lit("click", "purchase")).alias("hit"), text.common("kinds", lit("click", "view")).alias("both"))


@query("ST-04_upsert", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS price FROM orders")
def st04(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    again = rows.where("o_orderstatus = 'P'").withColumn("price", F.lit(0.0))
    return cascade.upserted(rows, again, ["o_orderkey"]).select("o_orderkey", "price")


# stateful pieces in batch


@query("SS-02_progress", "WITH e AS (SELECT user_id, event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS done, event_type FROM events) SELECT user_id AS job_id, event_id AS seq, CAST(greatest(0, least(100, CASE event_type WHEN 'purchase' THEN 10 + done * 70 // 4 WHEN 'view' THEN 5 + done * 70 // 4 ELSE 95 END)) AS INTEGER) AS percent FROM e")
def ss02(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "site_finished").when(F.col("event_type") == "view", "site_started").otherwise("wrapping_up")
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return progress.progress(e).select("job_id", "seq", "percent")


@query("SS-03_latest", "SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def ss03(spark, d):
    return progress.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SS-04_timeout", "SELECT user_id, epoch(max(ts)) - epoch(min(ts)) > 240 AS late, CASE WHEN epoch(max(ts)) - epoch(min(ts)) > 240 THEN 'Failed' ELSE 'Success' END AS status FROM events GROUP BY 1")
def ss04(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("elapsed"))
    return e.select("user_id", (F.col("elapsed") > 240).alias("late"), progress.timed_out("elapsed").alias("status"))


@query("SS-06_degradation_log", f"SELECT component, min_by(cause, seq) AS cause FROM {values(LOG, 'seq, component, cause')} GROUP BY 1")
def ss06(spark, d):
    return judge.degradations(spark.createDataFrame(LOG, "seq bigint, component string, cause string")).select("component", "cause")


@query("SS-07_timed_reveal", "SELECT e.event_id FROM events e WHERE e.user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING min(event_id) <= 5000)")
def ss07(spark, d):
    return progress.revealed(table(spark, d, "events"), ["user_id"], "event_id", 5000).select("event_id")


# judgements


@query("UD-03_title_verdict", """
    SELECT d.doc_id, CASE WHEN trim(d.source) = '' THEN TRUE WHEN lower(d.source) = lower(d.lang) THEN TRUE ELSE coalesce(l.m, TRUE) END AS match, trim(d.source) <> '' AND (lower(d.source) = lower(d.lang) OR l.m IS NOT NULL) AS verified
    FROM documents d LEFT JOIN (SELECT 'src1' AS source, 'en' AS lang, FALSE AS m UNION ALL SELECT 'src2', 'fr', TRUE) l ON l.source = d.source AND l.lang = d.lang""")
def ud03(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("expected"), F.col("lang").alias("scraped"))
    verdicts = spark.createDataFrame([("src1", "en", False), ("src2", "fr", True)], "expected string, scraped string, match boolean")
    return judge.titles(rows, verdicts).select("doc_id", "match", "verified")


@query("UD-04_price_verdict", """
    SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN FALSE ELSE coalesce(v.ok, TRUE) END AS plausible, s_acctbal <= 0 OR v.ok IS NOT NULL AS verified
    FROM supplier LEFT JOIN (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS ok FROM supplier WHERE s_nationkey < 5) v ON v.k = s_suppkey""")
def ud04(spark, d):
    s = table(spark, d, "supplier")
    rows = s.select("s_suppkey", F.lit("Amazon.com").alias("website"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("price"))
    v = s.where("s_nationkey < 5").select(F.lit("Amazon.com").alias("website"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("price"), (F.col("s_suppkey") % 2 == 0).alias("plausible"))
    return judge.prices(rows, v).select("s_suppkey", "plausible", "verified")


@query("UD-06_trust_verdict", """
    SELECT doc_id, CASE WHEN r IS NULL THEN 'Unknown' WHEN v = 1 THEN 'High' WHEN r >= 4.8 AND n >= 10000 THEN 'Low' ELSE 'Medium' END AS trust_label
    FROM (SELECT d.doc_id, CASE WHEN n_chars % 7 > 0 THEN 4 + (n_chars % 10) / 10 END AS r, n_chars * 5 AS n, l.toxic AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def ud06(spark, d):
    r = F.when(F.col("n_chars") % 7 > 0, 4 + (F.col("n_chars") % 10) / 10)
    rows = table(spark, d, "documents").select("doc_id", F.lit("Amazon.com").alias("website"), F.col("doc_id").cast("string").alias("title"), r.alias("average_rating"), (F.col("n_chars") * 5).alias("review_count"))
    v = table(spark, d, "labels").where("toxic = 1").select(F.lit("Amazon.com").alias("website"), F.col("doc_id").cast("string").alias("title"), F.lit("High").alias("trust_label"))
    return judge.trusted(rows, v).select("doc_id", "trust_label")


@query("UD-07_trust_rule", "SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'Unknown' WHEN 4 + (n_chars % 10) / 10 >= 4.8 AND n_chars * 5 >= 10000 THEN 'Low' ELSE 'Medium' END AS trust_label FROM documents")
def ud07(spark, d):
    r = F.when(F.col("n_chars") % 7 > 0, 4 + (F.col("n_chars") % 10) / 10)
    return table(spark, d, "documents").select("doc_id", judge.trust(r, F.col("n_chars") * 5).alias("trust_label"))


@query("UD-08_consequences", f"SELECT component, consequence FROM {values([(c, t) for _, c, t in fixed.COMPONENTS], 'component, consequence')}")
def ud08(spark, d):
    return judge.components(spark).select("component", "consequence")
