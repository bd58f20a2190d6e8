"""Jobs and what runs leave behind (SINK, SS, CA-13), recorded runs, and operators that are parts of others."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import cascade, html, matching
from ..session import shared_dir
from ..sources import sinks, tables
from ..sources.settings import Settings
from ..streaming import jobs
from .common import expect, formed_pairs, on_pairs, query, table, values
from .pages import ANSWERS, PLANS, serp_pages
from .relational import PLACED, scored
from .scalars import DUCK_CHIPS

KIND = "CASE event_type WHEN 'purchase' THEN 'site_finished' WHEN 'view' THEN 'site_started' ELSE 'done' END"
SITE_SLUGS = "['amazoncom', 'bestbuycom', 'walmartcom', 'neweggcom']"


def job_events(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "site_finished").when(F.col("event_type") == "view", "site_started").otherwise("done")
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"))


def job_states(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"))
    return jobs.states(known, job_events(spark, d).drop("ts"))


JOB_STATES = """
    SELECT c_custkey AS job_id, CASE WHEN t NOT IN ('purchase', 'view') THEN 'done' ELSE 'running' END AS status,
        CAST(CASE WHEN t IS NULL THEN 0 WHEN t = 'purchase' THEN least(100, 10 + done * 70 // 4) WHEN t = 'view' THEN least(100, 5 + done * 70 // 4) ELSE 100 END AS INTEGER) AS percent,
        coalesce(n, 0) AS n_events
    FROM customer LEFT JOIN (
        SELECT user_id, max_by(event_type, event_id) AS t, max_by(done, event_id) AS done, count(*) AS n FROM (
            SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS done FROM events) GROUP BY 1) ON user_id = c_custkey"""


@query("SS-01_job_store", JOB_STATES)
def ss01(spark, d):
    return job_states(spark, d)


@query("SS-05_polls", f"""
    WITH e AS (SELECT user_id AS job_id, event_id AS seq, ts, epoch_ms(ts) AS ms, {KIND} = 'done' AS ends FROM events),
    o AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended,
        CAST(ceil((ms - min(ms) OVER (PARTITION BY job_id)) / 800) AS BIGINT) AS first_poll FROM e),
    p AS (SELECT job_id, seq, first_poll, coalesce(lead(first_poll) OVER (PARTITION BY job_id ORDER BY ts, seq) - first_poll, 1) AS n_polls FROM o WHERE ended = 0)
    SELECT * FROM p WHERE n_polls > 0""")
def ss05(spark, d):
    return jobs.polled(job_events(spark, d))


@query("CA-13_job_lookup", f"""
    SELECT q.job_id, CASE WHEN s.job_id IS NULL THEN 404 ELSE 200 END AS http_status,
        CASE WHEN s.job_id IS NULL THEN '{jobs.GONE}' END AS detail, s.status, s.percent, s.n_events
    FROM (SELECT l_orderkey AS job_id FROM lineitem WHERE l_linenumber = 1) q LEFT JOIN ({JOB_STATES}) s ON s.job_id = q.job_id""")
def ca13(spark, d):
    asked = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("job_id"))
    return jobs.looked_up(asked, job_states(spark, d))


@query("SINK-03_page_dump", f"SELECT page_id, {SITE_SLUGS}[CAST(page_id % 4 AS INTEGER) + 1] AS site, CASE WHEN page_id % 3 = 0 THEN 'serp' ELSE 'product' END AS kind, html FROM pages")
def sink03(spark, d):
    names = F.array(*(F.lit(r[1]) for r in fixed.RETAILERS))
    captures = table(spark, d, "pages").select("page_id", F.get(names, (F.col("page_id") % 4).cast("int")).alias("website"), F.when(F.col("page_id") % 3 == 0, "serp").otherwise("product").alias("kind"), "html")
    where = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    sinks.dump_pages(captures, where)
    return spark.read.parquet(where).select("page_id", "site", "kind", "html")


@query("SINK-04_job_log", f"""
    SELECT e.user_id AS job_id, strftime(s.ts, '%Y%m%d-%H%M%S') || '_' || left(CAST(e.user_id AS VARCHAR), 8) || '_user-' || e.user_id AS folder, e.event_id AS seq,
        strftime(e.ts, '%Y-%m-%d %H:%M:%S') || ' INFO ' || {KIND} AS line
    FROM events e JOIN (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1) s ON s.user_id = e.user_id""")
def sink04(spark, d):
    events = job_events(spark, d)
    known = events.select("job_id").distinct().withColumn("query", F.concat(F.lit("User "), F.col("job_id").cast("string"), F.lit("!")))
    return sinks.job_logs(known, events)


RECORDED = [(0, "Amazon.com", "$79.99", True), (1, "BestBuy.com", "N/A", False), (2, "Walmart.com", "$79.99", True), (3, "Newegg.com", "$89.99", True)]


@query("SRC-14_recorded_run", f"SELECT 'mouse' AS query, pos, website, price, has_price FROM {values(RECORDED, 'pos, website, price, has_price')}")
def src14(spark, d):
    rows = [{"website": w, "price": p, "has_price": h} for _, w, p, h in RECORDED]
    where = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps({"query": "mouse", "result": {"query": "mouse", "rows": rows}}, indent=1),)], "value string").coalesce(1).write.text(where)
    return tables.recorded_run(spark, where).select("query", "pos", "website", "price", "has_price")


@query("JS-04_price_blob", f"SELECT * FROM {values([*[(1, k) for k in ('amazon', 'bestbuy', 'walmart', 'newegg')], (2, 'Amazon'), (2, 'Best Buy')], 'query_id, key')}")
def js04(spark, d):
    return spark.createDataFrame(ANSWERS, "query_id int, body string").select("query_id", F.explode(F.map_keys(tables.price_blob("body"))).alias("key"))


@query("AG-05_chip_extremes", on_pairs(f"list_max({DUCK_CHIPS.format('q')}) AS newest, list_min({DUCK_CHIPS.format('q')}) AS oldest"))
def ag05(spark, d):
    c = text.chips("query_form.normalized")
    return formed_pairs(spark, d).select("pair_id", F.array_max(c).alias("newest"), F.array_min(c).alias("oldest"))


SONY, CASE, HARD = "Sony WH-1000XM5 Headphones", "Case for Sony headphones", "Headphones hard case"
ADMITTED = [
    (1, "Amazon.com", 0, 0, SONY, True), (1, "Amazon.com", 0, 1, CASE, True), (1, "Amazon.com", 0, 2, "Sony sponsored row", False), (1, "Amazon.com", 0, 3, "See options", False),
    (1, "Amazon.com", 1, 4, SONY, True), (1, "Amazon.com", 1, 5, CASE, True), (1, "Amazon.com", 1, 6, "Sony sponsored row", True), (1, "Amazon.com", 1, 7, "See options", False),
    (2, "BestBuy.com", 0, 0, "Sony WH-1000XM5 Wireless Headphones", True), (2, "BestBuy.com", 0, 1, "Sony WH-1000XM5 again", True),
    (2, "BestBuy.com", 1, 2, "Sony WH-1000XM5 Wireless Headphones", True), (2, "BestBuy.com", 1, 3, "Sony WH-1000XM5 again", True),
    (3, "Walmart.com", 0, 0, "Sony WH-1000XM5 Headphones Black", True), (3, "Walmart.com", 0, 1, "Other Sponsored Headphones", False),
    (4, "Newegg.com", 0, 0, SONY, True), (4, "Newegg.com", 0, 1, HARD, False), (4, "Newegg.com", 0, 2, SONY, True), (4, "Newegg.com", 0, 3, HARD, True), (4, "Newegg.com", 1, 4, SONY, True), (4, "Newegg.com", 1, 5, HARD, True),
    (7, "Walmart.com", 0, 0, "hidden listing", True), (8, "Amazon.com", 1, 0, "Lenovo Tab P12 tablet 128GB", True),
]


@query("FL-16_serp_admission", expect(ADMITTED, "page_id, website, path, pos, title, admitted"))
def fl16(spark, d):
    return html.admission(html.serp_facts(serp_pages(spark))).select("page_id", "website", "path", "pos", "title", "admitted")


@query("UD-02_judged_plans", f"""
    SELECT * FROM {values([(1, 'Amazon.com', 'sony wh', 'Sony WH-1000XM5'), (1, 'BestBuy.com', 'Sony XM5', 'Sony XM5'), (1, 'Walmart.com', 'Sony W', 'Sony W'), (1, 'Newegg.com', 'sony', 'sony'),
    *[(q, s, t, t) for q, t in ((2, 'tab'), (3, 'unasked')) for s in ('Amazon.com', 'BestBuy.com', 'Walmart.com', 'Newegg.com')]], 'query_id, website, search_query, match_query')}""")
def ud02(spark, d):
    asked = spark.createDataFrame([*((q, u) for q, u, _ in PLANS), (3, "unasked")], "query_id int, user_query string")
    plans = tables.answered_plans(spark.createDataFrame(PLANS, "query_id int, user_query string, body string"))
    return cascade.planned(asked, tables.retailers(spark), plans).select("query_id", "website", "search_query", "match_query")


FOUND = [(1, "Amazon.com", 99.5), (1, "BestBuy.com", 1000.0), (1, "Walmart.com", 5.0), (2, "Amazon.com", 12.5), (2, "BestBuy.com", 12.0), (3, "Newegg.com", 1.0)]


@query("UD-05_judged_prices", f"SELECT * FROM {values([(1, 'BestBuy.com', 1000.0), (2, 'Amazon.com', 12.5)], 'query_id, website, price')}")
def ud05(spark, d):
    """Found prices that lie more than a fifth from what the model expects."""
    rows = spark.createDataFrame(FOUND, "query_id int, website string, price double")
    answers = tables.answered_prices(spark.createDataFrame(ANSWERS, "query_id int, body string"))
    return cascade.gap_outliers(rows, answers, 0.2).select("query_id", "website", "price")


@query("CA-06_failed_alternates", f"""
    WITH failed AS (SELECT user_id, event_id FROM ({PLACED}) WHERE place = 1 AND event_type = 'view'),
    a AS (SELECT p.*, row_number() OVER (PARTITION BY p.user_id ORDER BY place) AS attempt FROM ({PLACED}) p JOIN failed f ON f.user_id = p.user_id AND f.event_id <> p.event_id)
    SELECT user_id, min_by(event_id, attempt) AS event_id FROM a WHERE attempt <= 5 AND event_type <> 'view' GROUP BY 1""")
def ca06(spark, d):
    """Where the best candidate's page gave nothing, the first of the next ones that does."""
    ranked = matching.ranked(scored(spark, d), ["user_id"])
    failed = ranked.where("place = 1 AND event_type = 'view'").select("user_id", F.col("event_id").alias("tried"))
    rest = ranked.join(failed, "user_id").where("event_id <> tried")
    return matching.first_valid(rest, F.col("event_type") != "view", F.lit(True), ["user_id"], fixed.MAX_ATTEMPTS).select("user_id", "event_id")


ENV = [(0, {}), (1, {"LLM_PRICE_VERIFY": "off", "PRICE_GAP_RESCRAPE": " 0 "}), (2, {"MIN_MATCH_SCORE_SOFT_FLOOR": "60", "PRICE_GAP_RESCRAPE_THRESHOLD": "x"}), (3, {"PAGE_SETTLE_MIN_S": "9", "PAGE_SETTLE_MAX_S": "2"})]


@query("SRC-10_settings", expect([(0, 42.0, 0.2, True, True, 3.0, 8.0), (1, 42.0, 0.2, False, False, 3.0, 8.0), (2, 47.9, 0.2, True, True, 3.0, 8.0), (3, 42.0, 0.2, True, True, 2.0, 9.0)], "i, soft_floor, price_gap, price_gap_enabled, price_verify, settle_min_s, settle_max_s"))
def src10(spark, d):
    read = [(i, Settings.from_env(env)) for i, env in ENV]
    rows = [(i, s.soft_floor, s.price_gap, s.price_gap_enabled, s.price_verify, s.settle_min_s, s.settle_max_s) for i, s in read]
    return spark.createDataFrame(rows, "i int, soft_floor double, price_gap double, price_gap_enabled boolean, price_verify boolean, settle_min_s double, settle_max_s double")


@query("UD-01_extractors", expect([(w, k) for _, w, _, _ in fixed.RETAILERS for k in ("serp", "pdp")], "website, kind"))
def ud01(spark, d):
    return spark.createDataFrame(html.extractors(), "website string, kind string")


FINDS = [(1, "Amazon.com", "amazon.com", " Sony XM5 ", " https://www.amazon.com/dp/B0AAAAAAA1#x "), (1, "BestBuy.com", "bestbuy.com", "Sony", "https://www.bestbuy.com/product/sony/JJ8"), (2, "Walmart.com", "walmart.com", "", "https://www.walmart.com/ip/x/731473988"), (2, "Newegg.com", "newegg.com", "Search", "https://www.newegg.com/p/pl?d=x")]


@query("SRC-06_discovered", expect([(1, "Amazon.com", 1, "Sony XM5", "https://www.amazon.com/dp/B0AAAAAAA1"), (1, "BestBuy.com", 1, "Sony", "https://www.bestbuy.com/product/sony/JJ8")], "query_id, website, rank, title, url"))
def src06(spark, d):
    found = spark.createDataFrame(FINDS, "query_id int, website string, domain string, title string, url string")
    return tables.discovered(found).select("query_id", "website", "rank", "title", "url")
