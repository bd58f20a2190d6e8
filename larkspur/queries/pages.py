"""Sources and sinks (SRC, SINK), JSON (JS), HTML extraction (EX) and cascades (CA)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import fixed, parse, text, urls
from ..operators import cascade, extractors, html, judge, matching
from ..plans import comparison
from ..plans.hooks import Hooks
from ..session import measured_joins, spread, stored
from ..sources import sinks, tables
from ..streaming import progress
from .common import expect, formed_pairs, query, table, values

# Captured search and product pages of the four retailers.


def _amazon_card(asin: str, title: str, extra: str = "") -> str:
    return f'<div data-component-type="s-search-result" data-asin="{asin}">{extra}<h2><a href="/{title.lower().replace(" ", "-")}/dp/{asin}?ref=1"><span>{title}</span></a></h2></div>'


def _ld(name: str, price: str, rating: str = "4.6", count: str = "1,234") -> str:
    return '<script type="application/ld+json">' + json.dumps({"@context": "x", "@type": "Product", "name": name, "offers": {"price": price}, "aggregateRating": {"ratingValue": rating, "reviewCount": count}}) + "</script>"


SERPS = [
    (1, 1, "Amazon.com", "https://www.amazon.com/s?k=sony", "<html>" + _amazon_card("B0AAAAAAA1", "Sony WH-1000XM5 Headphones") + _amazon_card("B0AAAAAAA2", "Case for Sony headphones") + _amazon_card("B0AAAAAAA3", "Sony sponsored row", "<span class='puis-sponsored-label-text'>x</span>") + _amazon_card("B0AAAAAAA4", "See options") + "</html>"),
    (2, 1, "BestBuy.com", "https://www.bestbuy.com/site/searchpage.jsp?st=sony", "<ul><li class='sku-item'><h4 class='sku-title'><a href='/site/sony-wh1000xm5/6505727.p?skuId=6505727'>Sony WH-1000XM5 Wireless Headphones</a></h4></li><li class='sku-item'><h4 class='sku-title'><a href='/site/sony-wh1000xm5/6505727.p?x=2'>Sony WH-1000XM5 again</a></h4></li></ul>"),
    (3, 1, "Walmart.com", "https://www.walmart.com/search?q=sony", "<div data-item-id='1'><a link-identifier='itemClick' href='/ip/Sony-WH-1000XM5/731473988?x=1' aria-label='Sony WH-1000XM5 Headphones Black'></a></div><div data-item-id='2'><i data-automation-id='is-sponsored'></i><a href='/ip/Other/731473989'>Other Sponsored Headphones</a></div>"),
    (4, 1, "Newegg.com", "https://www.newegg.com/p/pl?d=sony", "<div class='item-cell'><a class='item-title' href='https://www.newegg.com/sony-wh-1000xm5/p/0TH-000U-00JF1?Item=9SIA'>Sony WH-1000XM5 Headphones</a></div><div class='item-cell'><a class='item-title' href='https://www.newegg.com/case/p/0TH-000U-00CASE'>Headphones hard case</a></div>"),
    (5, 2, "BestBuy.com", "https://www.bestbuy.com/site/searchpage.jsp?st=tab", "<script>{\"skuId\":\"6551465\",\"url\":\"/site/lenovo-tab-p12/6551465.p\"}</script>"),
    (6, 2, "Newegg.com", "https://www.newegg.com/p/pl?d=tab", "<script>\"https://www.newegg.com/p/3C6-0002-009C6\"</script>"),
    (7, 2, "Walmart.com", "https://www.walmart.com/search?q=tab", "<html>Robot or human?<a href='/ip/x/731473988'>hidden listing</a></html>"),
    (8, 2, "Amazon.com", "https://www.amazon.com/s?k=tab", "<p><a href='/dp/B0CCCCCCC1'>Lenovo Tab P12 tablet 128GB</a></p>"),
]

PDPS = [
    (11, 1, "Amazon.com", "https://www.amazon.com/sony-wh-1000xm5-headphones/dp/B0AAAAAAA1", _ld("Sony WH-1000XM5", "398.00") + "<span id='productTitle'> Sony WH-1000XM5 Headphones </span><div id='corePrice_feature_div'><span class='a-price'><span class='a-offscreen'>$348.00</span></span><div class='coupon'><span class='a-price'><span class='a-offscreen'>$20.00</span></span></div></div>"),
    (12, 1, "BestBuy.com", "https://www.bestbuy.com/site/sony-wh1000xm5/6505727.p", "<div class='sku-title'><h1>Sony WH-1000XM5 Wireless Headphones</h1></div><div class='priceView-customer-price'><span>$399.99</span></div><div class='c-ratings-reviews'>4.7</div><div class='c-reviews'>(12,345)</div>"),
    (13, 1, "Walmart.com", "https://www.walmart.com/ip/Sony-WH-1000XM5/731473988", "<h1 id='main-title'>Sony WH-1000XM5 Headphones Black</h1><span itemprop='price' content='329.5'>now</span><span itemprop='ratingValue' content='4.4'></span>"),
    (14, 1, "Newegg.com", "https://www.newegg.com/sony-wh-1000xm5/p/0TH-000U-00JF1", "<h1 class='product-title'>Sony WH-1000XM5 Headphones</h1>"),
    (15, 2, "Amazon.com", "https://www.amazon.com/dp/B0CCCCCCC1", "<span id='productTitle'>Apple MacBook Pro 14 inch M5</span><div id='desktop_buybox'><span class='a-price'><span class='a-offscreen'>$133.25</span></span><span>/mo</span></div><div id='centerCol'><span class='a-price'><span class='a-offscreen'>$1,599.00</span></span></div>"),
    (16, 2, "Amazon.com", "https://www.amazon.com/dp/B0CCCCCCC2", _ld("Trap", "89.00") + "<span id='productTitle'>Apple MacBook Air M4</span><div id='corePrice_desktop'><span class='a-price'><span class='a-offscreen'>$542.00</span></span></div><span class='basisPrice'><span class='a-offscreen'>$1,496.00</span></span>"),
]

BODIES = [
    (1, "walmart.com", json.dumps({"results": [{"title": "Sony WH-1000XM5", "url": "https://www.walmart.com/ip/Sony/731473988"}, {"title": "", "url": "https://www.walmart.com/ip/x/731473989"}, {"title": "Made up", "url": "https://www.walmart.com/ip/x/123456789"}]})),
    (2, "bestbuy.com", json.dumps({"results": [{"title": "Lenovo Tab P12", "url": "6551465"}, {"title": "Search", "url": "https://www.bestbuy.com/site/searchpage.jsp?st=x"}]})),
    (3, "newegg.com", "not json"),
]
FIELD_BODIES = [(1, json.dumps({"title": "Sony", "price": "$348.00", "average_rating": "4.6", "review_count": "1,234"})), (2, json.dumps({"title": "Sony", "price": None})), (3, json.dumps({"title": "Access Denied", "price": 5}))]
LD = [
    (1, 0, json.dumps({"@type": "Product", "name": "A", "offers": [{"price": "0"}, {"lowPrice": "12.50"}], "aggregateRating": {"ratingValue": "47", "ratingCount": 9}})),
    (1, 1, json.dumps({"@graph": [{"@type": "Thing"}, {"@type": "Product", "name": "B", "offers": {"price": 99.5}}]})),
    (2, 0, json.dumps([{"@type": "Product", "name": "", "offers": {"price": "1,299.00"}}, {"@type": "Product", "name": "C", "offers": {"price": "$7"}}])),
    (3, 0, "{bad json"),
    (4, 0, json.dumps({"@type": ["Product"], "name": "list type"})),
]


def serp_pages(spark):
    return spark.createDataFrame([(p, q, w, u, h) for p, q, w, u, h in SERPS], "page_id int, query_id int, website string, url string, html string")


def pdp_pages(spark):
    return spark.createDataFrame(PDPS, "page_id int, query_id int, website string, url string, html string")


#: What the fixed pages and bodies above have to give.
HOSTED = [(1, "walmart.com", 1, "Sony WH-1000XM5", "https://www.walmart.com/ip/Sony/731473988"), (2, "bestbuy.com", 1, "Lenovo Tab P12", "https://www.bestbuy.com/site/product/6551465.p")]
NEWEGG = [(4, 1, "Sony WH-1000XM5 Headphones", "https://www.newegg.com/sony-wh-1000xm5/p/0TH-000U-00JF1?Item=9SIA"), (4, 2, "Headphones hard case", "https://www.newegg.com/case/p/0TH-000U-00CASE"), (6, 1, "Newegg 3C6-0002-009C6", "https://www.newegg.com/p/3C6-0002-009C6")]
LISTED = [
    (1, "Amazon.com", 1, "Sony WH-1000XM5 Headphones", "https://www.amazon.com/sony-wh-1000xm5-headphones/dp/B0AAAAAAA1"), (1, "Amazon.com", 2, "Case for Sony headphones", "https://www.amazon.com/case-for-sony-headphones/dp/B0AAAAAAA2"),
    (2, "BestBuy.com", 1, "Sony WH-1000XM5 Wireless Headphones", "https://www.bestbuy.com/site/sony-wh1000xm5/6505727.p"), (3, "Walmart.com", 1, "Sony WH-1000XM5 Headphones Black", "https://www.walmart.com/ip/Sony-WH-1000XM5/731473988"),
    *((p, "Newegg.com", r, t, u) for p, r, t, u in NEWEGG), (5, "BestBuy.com", 1, "Lenovo Tab P12", "https://www.bestbuy.com/site/lenovo-tab-p12/6551465.p"), (5, "BestBuy.com", 2, "Product", "https://www.bestbuy.com/site/product/6551465.p"),
    (8, "Amazon.com", 1, "Lenovo Tab P12 tablet 128GB", "https://www.amazon.com/dp/B0CCCCCCC1"),
]
FACTS = [
    (11, "all", 2, "$348.00", 348.0, False, False, False), (11, "all", 3, "$20.00", 20.0, True, False, False), (11, "p0", 0, "$348.00", 348.0, False, False, False), (11, "p0", 1, "$20.00", 20.0, True, False, False), (11, "s0", 4, "$348.00", 348.0, False, False, False),
    (15, "all", 5, "$133.25", 133.25, False, False, True), (15, "all", 6, "$1,599.00", 1599.0, False, False, False), (15, "b0", 0, "$133.25", 133.25, False, False, True), (15, "b0-", 3, "", None, False, False, False),
    (15, "b2", 1, "$1,599.00", 1599.0, False, False, False), (15, "b2-", 4, "", None, False, False, False), (15, "r2", 2, "$1,599.00", 1599.0, False, False, False),
    (16, "all", 1, "$542.00", 542.0, False, False, False), (16, "p1", 0, "$542.00", 542.0, False, False, False), (16, "strike", 2, "$1,496.00", 1496.0, False, False, False),
]
SAID = [
    ("start", "Amazon.com", "Starting your search…"), ("site_started", "BestBuy.com", "Checking Best Buy…"), ("site_finished", "Walmart.com", "Finished with Walmart — found a price."),
    ("site_finished", "Newegg.com", "Finished with Newegg — no price found this time."), ("recheck_site", "Other.com", "Checking Other again…"), ("wrapping_up", "Amazon.com", "Putting your table together…"),
    ("done", "Amazon.com", "Search finished, but we couldn't find prices on any store."), ("done", "Amazon.com", "All done! Here is your comparison."), ("done", "Amazon.com", "All done! We found prices on 3 of 4 stores."),
]

# sources and sinks

ASKED = [(1, "  sony headphones "), (2, ""), (3, "   "), (4, "x" * 501), (5, "lenovo tab p12")]


@query("SRC-01_queries", f"SELECT CAST(query_id AS INTEGER) AS query_id, trim(q) AS user_query FROM {values(ASKED, 'query_id, q')} WHERE length(trim(q)) BETWEEN 1 AND 500")
def src01(spark, d):
    return tables.asked(spark.createDataFrame(ASKED, "query_id int, user_query string"))


@query("SRC-02_usable_captures", f"SELECT page_id FROM pages WHERE page_id % 7 <> 3 AND NOT regexp_matches(lower(html), '{'|'.join(fixed.BOT_PATTERNS)}')")
def src02(spark, d):
    p = table(spark, d, "pages").select("page_id", F.lit("BestBuy.com").alias("website"), "html", F.when(F.col("page_id") % 7 == 3, 403).otherwise(200).alias("http_status"))
    return tables.usable_captures(p).select("page_id")


@query("SRC-04_hosted_fields", expect([(1, "Sony", 348.0, 4.6, 1234, None), (2, "Sony", None, None, None, "missing price"), (3, "Access Denied", 5.0, None, None, "generic page title")], "page_id, title, price, average_rating, review_count, reject_reason"))
def src04(spark, d):
    return tables.hosted_fields(spark.createDataFrame(FIELD_BODIES, "page_id int, body string")).withColumn("price", F.col("price").cast("double"))


@query("SRC-05_hosted_serp", expect(HOSTED, "page_id, domain, rank, title, url"))
def src05(spark, d):
    return tables.hosted_serp(spark.createDataFrame(BODIES, "page_id int, domain string, body string"))


@query("SRC-07_known_pages", f"SELECT domain, title, url FROM {values([(r[0], r[3], r[4]) for r in tables.KNOWN_PAGES], 'domain, title, url')}")
def src07(spark, d):
    return tables.known_pages(spark).select("domain", "title", "url")


@query("SRC-08_retailers", f"SELECT CAST(site_order AS INTEGER) AS site_order, website, domain, search_prefix FROM {values(fixed.RETAILERS, 'site_order, website, domain, search_prefix')}")
def src08(spark, d):
    return tables.retailers(spark)


@query("SRC-12_reachable", "SELECT page_id, url LIKE 'http%' AND page_id % 5 NOT IN (2, 3) AS reachable FROM pages")
def src12(spark, d):
    status = F.when(F.col("page_id") % 5 == 2, 404).when(F.col("page_id") % 5 == 3, 410).when(F.col("page_id") % 5 == 1, 500)
    return table(spark, d, "pages").select("page_id", urls.reachable("url", status).alias("reachable"))


@query("SRC-13_resolved_path", "SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def src13(spark, d):
    return table(spark, d, "pages").select("page_id", urls.path("url").alias("path"))


@query("SINK-01_result_table", "SELECT p_partkey, CASE WHEN length(trim(p_name)) <= 60 THEN trim(p_name) ELSE substr(trim(p_name), 1, 57) || '...' END AS title, '$' || format('{:,.2f}', CAST(p_retailprice AS DECIMAL(18,2))) AS price FROM part")
def sink01(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"), F.lit(None).cast("double").alias("average_rating"), F.col("p_size").alias("review_count"))
    return cascade.display(p).select("p_partkey", text.truncated("product_title").alias("title"), F.col("price_shown").alias("price"))


@query("SINK-02_response_json", """
    SELECT user_id AS query_id, '{"rows":[' || string_agg('{"site_order":' || event_id || ',"website":"' || event_type || '","title":"t","price":1.5,"status":"' || CASE WHEN event_type <> 'view' THEN 'Success' ELSE 'Failed' END
            || '","method":"http","has_price":' || CASE WHEN event_type <> 'view' THEN 'true' ELSE 'false' END || '}', ',' ORDER BY event_id)
        || '],"success_count":' || count(*) FILTER (event_type <> 'view') || ',"total_sites":' || count(*) || ',"checks_skipped":[{"component":"title verify","consequence":"c","cause":"no key"},{"component":"price verify","consequence":"c","cause":"quota"}]}' AS body
    FROM events GROUP BY 1""")
def sink02(spark, d):
    status = F.when(F.col("event_type") != "view", "Success").otherwise("Failed")
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("site_order"), F.col("event_type").alias("website"), F.lit("t").alias("title"), F.lit(1.5).alias("price"),
        F.lit(None).cast("double").alias("average_rating"), F.lit(None).cast("bigint").alias("review_count"), status.alias("status"), F.lit("http").alias("method"),
    )
    skipped = spark.createDataFrame([("price verify", "c", "quota", 2), ("title verify", "c", "no key", 1)], "component string, consequence string, cause string, component_order int")
    return sinks.response_json(rows, skipped)


@query("SINK-05_enough_prices", "SELECT user_id, count(*) FILTER (event_type = 'purchase') >= 3 AS ok FROM events GROUP BY 1")
def sink05(spark, d):
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "purchase", "Success").otherwise("Failed").alias("status"), F.col("event_id").alias("price"))
    return cascade.enough_prices(rows, ["user_id"]).select("user_id", "ok")


MESSAGES = [("start", "Amazon.com", False, 0), ("site_started", "BestBuy.com", False, 0), ("site_finished", "Walmart.com", True, 1), ("site_finished", "Newegg.com", False, 1), ("recheck_site", "Other.com", False, 1), ("wrapping_up", "Amazon.com", False, 2), ("done", "Amazon.com", False, 0), ("done", "Amazon.com", False, 4), ("done", "Amazon.com", False, 3)]


@query("SF-32_messages", expect(SAID, "kind, website, message"))
def sf32(spark, d):
    m = spark.createDataFrame(MESSAGES, "kind string, website string, got boolean, success int")
    return m.select("kind", "website", progress.message("kind", "website", "got", "success", F.lit(4)).alias("message"))


# JSON


@query("JS-01_products", expect([(1, 0, 0, "A"), (1, 1, 1, "B"), (2, 0, 0, ""), (2, 0, 1000, "C")], "page_id, pos, item, name"))
def js01(spark, d):
    p = html.json_ld_products(spark.createDataFrame(LD, "page_id int, pos int, body string"), ["page_id"])
    return p.select("page_id", "pos", "item", F.try_variant_get("product", "$.name", "string").alias("name"))


@query("JS-02_product_fields", f"SELECT * FROM {values([(1, 0, 'A', 12.5, 4.7, 9), (1, 1, 'B', 99.5, None, None), (2, 0, '', 1299.0, None, None), (2, 0, 'C', 7.0, None, None)], 'page_id, pos, title, price, average_rating, review_count')}")
def js02(spark, d):
    f = html.json_ld_fields(html.json_ld_products(spark.createDataFrame(LD, "page_id int, pos int, body string"), ["page_id"]))
    return f.select("page_id", "pos", "title", F.col("price").cast("double").alias("price"), "average_rating", "review_count")


@query("JS-03_first_full_product", f"SELECT * FROM {values([(1, 'A'), (2, 'C')], 'page_id, title')}")
def js03(spark, d):
    bodies = spark.createDataFrame(LD, "page_id int, pos int, body string").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("listed"))
    found = bodies.withColumn("json_ld", F.transform("listed", lambda b: b["body"])).withColumn("found", html.first_ld_product())
    return found.where("found IS NOT NULL").select("page_id", "found.title")


ANSWERS = [(1, json.dumps({"amazon": 99.5, "bestbuy": "$1,299.00", "walmart": None, "newegg": -3})), (2, json.dumps({"prices": {"Amazon": 10, "Best Buy": 11}})), (3, "no json")]
PLANS = [(1, "sony", json.dumps({"amazon": {"search_query": "sony wh", "product_name": "Sony WH-1000XM5"}, "bestbuy": "Sony XM5", "walmart": {"product": "Sony W"}})), (2, "tab", "[]")]


@query("JS-05_reference_prices", f"SELECT * FROM {values([(1, 'Amazon.com', 99.5), (1, 'BestBuy.com', 1299.0), (1, 'Walmart.com', None), (1, 'Newegg.com', None), (2, 'Amazon.com', 10.0), (2, 'BestBuy.com', 11.0), (2, 'Walmart.com', None), (2, 'Newegg.com', None), (3, 'Amazon.com', None), (3, 'BestBuy.com', None), (3, 'Walmart.com', None), (3, 'Newegg.com', None)], 'query_id, website, ref_price')}")
def js05(spark, d):
    r = tables.answered_prices(spark.createDataFrame(ANSWERS, "query_id int, body string"))
    return r.select("query_id", "website", F.col("ref_price").cast("double").alias("ref_price"))


@query("JS-06_search_plans", f"SELECT * FROM {values([(1, 'Amazon.com', 'sony wh', 'Sony WH-1000XM5'), (1, 'BestBuy.com', 'Sony XM5', 'Sony XM5'), (1, 'Walmart.com', 'Sony W', 'Sony W'), (1, 'Newegg.com', 'sony', 'sony'), *[(2, s, 'tab', 'tab') for s in ('Amazon.com', 'BestBuy.com', 'Walmart.com', 'Newegg.com')]], 'query_id, website, search_query, match_query')}")
def js06(spark, d):
    return tables.answered_plans(spark.createDataFrame(PLANS, "query_id int, user_query string, body string")).select("query_id", "website", "search_query", "match_query")


BOOLS = ["true", "Yes", " 1 ", "no", "", "false", "2"]
ACTS = [(0, "accept", False), (1, "try-next-candidate", False), (2, "Refine_Search", False), (3, "reject_junk", False), (4, "whatever", False), (5, "reject_junk", True)]


@query("JS-07_booleans", f"SELECT i, lower(trim(s)) IN ('true', 'yes', '1') AS yes FROM {values(list(enumerate(BOOLS)), 'i, s')}")
def js07(spark, d):
    return spark.createDataFrame(list(enumerate(BOOLS)), "i int, s string").select("i", judge.truthy("s").alias("yes"))


@query("JS-08_actions", f"SELECT i, CASE WHEN m THEN 'accept' WHEN replace(lower(trim(s)), '-', '_') IN ('try_next_candidate', 'refine_search', 'reject_junk') THEN replace(lower(trim(s)), '-', '_') ELSE 'try_next_candidate' END AS action FROM {values(ACTS, 'i, s, m')}")
def js08(spark, d):
    return spark.createDataFrame(ACTS, "i int, s string, m boolean").select("i", judge.action("s", "m").alias("action"))


# HTML


@query("EX-00_links", "WITH l AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1) AS h FROM pages) SELECT page_id, len(h) AS n_links, len(list_distinct(h)) AS n_distinct FROM l WHERE len(h) > 0")
def ex00(spark, d):
    f = html.links(table(spark, d, "pages"), ["page_id", "url"])
    return f.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("href").alias("n_distinct"))


def _serp_of(website: str):
    def run(spark, d):
        return html.serp(serp_pages(spark).where(F.col("website") == website).drop("query_id")).select("page_id", "rank", "title", "url")

    return run


def _expect(rows, columns="page_id, rank, title, url"):
    return expect(rows, columns)


query("EX-01_amazon_serp", _expect([(1, 1, "Sony WH-1000XM5 Headphones", "https://www.amazon.com/sony-wh-1000xm5-headphones/dp/B0AAAAAAA1"), (1, 2, "Case for Sony headphones", "https://www.amazon.com/case-for-sony-headphones/dp/B0AAAAAAA2"), (8, 1, "Lenovo Tab P12 tablet 128GB", "https://www.amazon.com/dp/B0CCCCCCC1")]))(_serp_of("Amazon.com"))
query("EX-02_bestbuy_serp", _expect([(2, 1, "Sony WH-1000XM5 Wireless Headphones", "https://www.bestbuy.com/site/sony-wh1000xm5/6505727.p"), (5, 1, "Best Buy SKU 6551465", "https://www.bestbuy.com/site/product/6551465.p")]) + " WHERE page_id = 2 UNION ALL " + _expect([(5, 1, "Lenovo Tab P12", "https://www.bestbuy.com/site/lenovo-tab-p12/6551465.p"), (5, 2, "Product", "https://www.bestbuy.com/site/product/6551465.p")]))(_serp_of("BestBuy.com"))
query("EX-03_walmart_serp", _expect([(3, 1, "Sony WH-1000XM5 Headphones Black", "https://www.walmart.com/ip/Sony-WH-1000XM5/731473988")]))(_serp_of("Walmart.com"))
query("EX-04_newegg_serp", _expect(NEWEGG))(_serp_of("Newegg.com"))


@query("EX-05_salvage", expect([(4, "Newegg.com", 0, "Newegg 0TH-000U-00JF1", "https://www.newegg.com/sony-wh-1000xm5/p/0TH-000U-00JF1?Item=9SIA"), (5, "BestBuy.com", 0, "Lenovo Tab P12", "https://www.bestbuy.com/site/lenovo-tab-p12/6551465.p"), (5, "BestBuy.com", 1, "Product", "https://www.bestbuy.com/site/product/6551465.p"), (6, "Newegg.com", 0, "Newegg 3C6-0002-009C6", "https://www.newegg.com/p/3C6-0002-009C6")], "page_id, website, pos, title, url"))
def ex05(spark, d):
    return html.salvage(serp_pages(spark)).select("page_id", "website", "pos", "title", "url")


@query("EX-06_serp_dispatch", expect(LISTED, "page_id, website, rank, title, url"))
def ex06(spark, d):
    return html.serp(serp_pages(spark).drop("query_id")).select("page_id", "website", "rank", "title", "url")


@query("EX-08_price_facts", expect(FACTS, "page_id, region, pos, raw, price, in_addon, teaser, financing"))
def ex08(spark, d):
    f = html.product_facts(pdp_pages(spark).where("website = 'Amazon.com'"))
    return f.select("page_id", F.explode(html.judged_prices()).alias("x")).select("page_id", "x.*").withColumn("price", F.col("price").cast("double"))


@query("EX-07_product_fields", _expect([(11, "Sony WH-1000XM5 Headphones", 348.0), (12, "Sony WH-1000XM5 Wireless Headphones", 399.99), (13, "Sony WH-1000XM5 Headphones Black", 329.5), (14, "Sony WH-1000XM5 Headphones", None), (15, "Apple MacBook Pro 14 inch M5", 1599.0), (16, "Apple MacBook Air M4", 1496.0)], "page_id, title, price"))
def ex07(spark, d):
    return html.product_fields(pdp_pages(spark)).select("page_id", "title", F.col("price").cast("double").alias("price"))


def _pdp_of(website: str):
    def run(spark, d):
        return html.product_fields(pdp_pages(spark).where(F.col("website") == website)).select("page_id", "title", F.col("price").cast("double").alias("price"), "average_rating", "review_count")

    return run


query("EX-09_bestbuy_product", _expect([(12, "Sony WH-1000XM5 Wireless Headphones", 399.99, 4.7, 12345)], "page_id, title, price, average_rating, review_count"))(_pdp_of("BestBuy.com"))
query("EX-10_walmart_product", _expect([(13, "Sony WH-1000XM5 Headphones Black", 329.5, 4.4, None)], "page_id, title, price, average_rating, review_count"))(_pdp_of("Walmart.com"))
query("EX-11_newegg_product", _expect([(14, "Sony WH-1000XM5 Headphones", None, None, None)], "page_id, title, price, average_rating, review_count"))(_pdp_of("Newegg.com"))


@query("EX-12_model_fields", _expect([(1, "Sony", 348.0, None), (2, "Sony", None, "missing price"), (3, "Access Denied", 5.0, "generic page title")], "page_id, title, price, reject_reason"))
def ex12(spark, d):
    f = tables.hosted_fields(spark.createDataFrame(FIELD_BODIES, "page_id int, body string"))
    return f.select("page_id", "title", F.col("price").cast("double").alias("price"), "reject_reason")


@query("UR-04_absolute_links", r"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="(/[^"/][^"]*)"', 1)) AS h FROM pages)
    SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || replace(h, '&amp;', '&') AS link, count(*) AS n FROM l GROUP BY 1, 2""")
def ur04(spark, d):
    f = html.links(table(spark, d, "pages"), ["page_id", "url"]).where(F.col("href").rlike("^/[^/]"))
    return f.groupBy("page_id", F.col("absolute").alias("link")).agg(F.count(F.lit(1)).alias("n"))


@query("EX-13_model_serp", expect(HOSTED, "page_id, domain, rank, title, url"))
def ex13(spark, d):
    return tables.model_serp(spark.createDataFrame(BODIES, "page_id int, domain string, body string"))


@query("EX-14_page_facts", "SELECT page_id, trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&')) AS page_title, trim(replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), '&amp;', '&')) AS heading FROM pages")
def ex14(spark, d):
    pages = table(spark, d, "pages").withColumn("given", F.col("html").isNotNull())
    facts = html.page_facts(pages, ["page_id", "given"])
    return facts.select("page_id", *(F.when(F.col("given"), F.coalesce(c, F.lit(""))).alias(c) for c in ("page_title", "heading")))


# cascades and the whole plan


@query("CA-01_extraction_cascade", "SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS stage FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' GROUP BY 1")
def ca01(spark, d):
    staged = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("stage"), F.col("o_totalprice").alias("price"), F.when((F.col("o_totalprice") <= 1000) | (F.col("o_orderstatus") == "P"), "bad").alias("reject_reason"))
    return cascade.first_success(staged, ["o_custkey"])


@query("CA-02_retry_cascade", "SELECT o_custkey, min_by(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS stage FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def ca02(spark, d):
    staged = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_custkey", F.col("o_orderkey").alias("stage"), F.col("o_totalprice").alias("price"), F.lit(None).cast("string").alias("reject_reason"))
    return cascade.first_success(staged, ["o_custkey"])


@query("CA-03_serp_cascade", "SELECT o_custkey, o_orderkey FROM orders QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey)")
def ca03(spark, d):
    return cascade.first_stage(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority").select("o_custkey", "o_orderkey")


def captures(spark):
    rows = [(p, q, w, "serp", 1, "http", u, 200, h) for p, q, w, u, h in SERPS] + [(p, q, w, "pdp", 1, "http", u, 200, h) for p, q, w, u, h in PDPS]
    return spark.createDataFrame(rows, "page_id int, query_id int, website string, kind string, stage int, method string, url string, http_status int, html string")


def compared(spark):
    q = spark.createDataFrame([(1, "sony wh-1000xm5 headphones"), (2, "lenovo tab p12")], "query_id int, user_query string")
    plans = spark.createDataFrame([], "query_id int, website string, search_query string, match_query string")
    references = spark.createDataFrame([(1, "Amazon.com", 280.0), (1, "BestBuy.com", 400.0)], "query_id int, website string, ref_price double").withColumn("ref_price", F.col("ref_price").cast(parse.PRICE))
    titles = spark.createDataFrame([], "expected string, scraped string, match boolean")
    prices = spark.createDataFrame([], "website string, title string, price decimal(38,10), plausible boolean")
    return comparison.compare(q, plans, captures(spark), references, titles, prices)


@query("CA-04_comparison", _expect([(1, "Amazon.com", 348.0, "Success", True), (1, "BestBuy.com", 399.99, "Success", False), (1, "Walmart.com", 329.5, "Success", False), (1, "Newegg.com", None, "Failed", False), (2, "Amazon.com", None, "Failed", False), (2, "BestBuy.com", None, "Failed", False), (2, "Walmart.com", None, "Failed", False), (2, "Newegg.com", None, "Failed", False)], "query_id, website, price, status, price_outlier"))
def ca04(spark, d):
    return compared(spark).select("query_id", "website", F.col("price").cast("double").alias("price"), "status", "price_outlier")


def part_pages(spark, d, item="item", turn=0):
    """``page_id, query_id, website, url, price, name, card, html`` of a product page for each part, at one retailer each.

    Pages of another ``turn`` are of another item, with another address and price.
    """
    p = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", (F.round("p_retailprice", 2) + turn).alias("price")), "p_partkey")
    site = (F.col("p_partkey") % 4).cast("int")
    name = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit(item))
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    of = lambda *cases: F.coalesce(*(F.when(site == k, c) for k, c in enumerate(cases)))
    own = F.col("p_partkey") + 5_000_000 * turn
    number = F.format_string("731%07d", own)
    path = of(F.format_string("/dp/B%09d", own), F.concat(F.lit("/site/"), slug, F.lit("/"), number, F.lit(".p")), F.concat(F.lit("/ip/"), slug, F.lit("/"), number), F.concat(F.lit("/"), slug, F.lit("/p/0TH-"), number))
    home = of(*(F.lit(f"https://www.{r[2]}") for r in fixed.RETAILERS))
    link = F.concat(F.lit("<a href='"), home, path, F.lit("'>"), name, F.lit("</a>"))
    card = of(
        F.concat(F.format_string("<div data-component-type='s-search-result' data-asin='B%09d'><h2>", own), link, F.lit("</h2></div>")), F.concat(F.lit("<li class='sku-item'><h4 class='sku-title'>"), link, F.lit("</h4></li>")),
        F.concat(F.lit("<div data-item-id='1'>"), link, F.lit("</div>")), F.concat(F.lit("<div class='item-cell'>"), F.replace(link, F.lit("<a "), F.lit("<a class='item-title' ")), F.lit("</div>")),
    )
    product = F.to_json(F.struct(F.lit("Product").alias("@type"), name.alias("name"), F.struct(F.col("price")).alias("offers")))
    page = F.concat(F.lit("<html><script type='application/ld+json'>"), product, F.lit("</script><h1>"), name, F.lit("</h1></html>"))
    website = of(*(F.lit(r[1]) for r in fixed.RETAILERS))
    return p.select("p_partkey", website.alias("website"), F.concat(home, path).alias("url"), F.concat(home, F.lit("/s?k="), F.col("p_partkey").cast("string")).alias("search"), "price", name.alias("name"), card.alias("card"), page.alias("html"))


def _capture(rows, k, kind, url, html_, status=200):
    """Captures of one kind; ``k`` tells the pages of a part apart."""
    return rows.select(
        (F.col("p_partkey") * 4 + k).alias("page_id"), F.col("p_partkey").alias("query_id"), "website", F.lit(kind).alias("kind"), F.lit(1).alias("stage"), F.lit("http").alias("method"),
        F.col(url).alias("url"), (F.lit(status) if isinstance(status, int) else status).alias("http_status"), html_.alias("html"),
    )


def part_captures(spark, d):
    """A search page and a product page for each part: captures that grow with the table."""
    p = part_pages(spark, d)
    return _capture(p, 0, "serp", "search", F.concat(F.lit("<html>"), "card", F.lit("</html>"))).unionByName(_capture(p, 1, "pdp", "url", F.col("html")))


@query("CA-04_comparison_of_parts", """
    SELECT p_partkey AS query_id, w AS website, CASE WHEN k = p_partkey % 4 THEN round(p_retailprice, 2) END AS price, CASE WHEN k = p_partkey % 4 THEN 'Success' ELSE 'Failed' END AS status
    FROM part, (SELECT unnest(['Amazon.com', 'BestBuy.com', 'Walmart.com', 'Newegg.com']) AS w, unnest(range(4)) AS k)""")
def ca04_parts(spark, d):
    """The whole plan over a table of pages that grows with the data."""
    return _compared_parts(spark, d).select("query_id", "website", F.col("price").cast("double").alias("price"), "status")


def _compared_parts(spark, d, hooks=None):
    nothing = lambda ddl: spark.createDataFrame([], ddl)
    return comparison.compare(
        _asked_parts(spark, d), nothing("query_id bigint, website string, search_query string, match_query string"), stored(part_captures(spark, d), "captures"), nothing("query_id bigint, website string, ref_price decimal(38,10)"),
        nothing("expected string, scraped string, match boolean"), nothing("website string, title string, price decimal(38,10), plausible boolean"), hooks=hooks,
    )


def _asked_parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("user_query"))


@query("CA-04_comparison_of_offers", """
    SELECT p_partkey AS query_id, w AS website, CASE WHEN k <> p_partkey % 4 OR p_partkey % 5 = 4 THEN 'Failed' ELSE 'Success' END AS status,
        CASE WHEN k <> p_partkey % 4 OR p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 2 THEN round(p_retailprice, 2) WHEN p_partkey % 5 = 3 THEN round(p_retailprice, 2) + 7 ELSE round(p_retailprice, 2) + 1 END AS price
    FROM part, (SELECT unnest(['Amazon.com', 'BestBuy.com', 'Walmart.com', 'Newegg.com']) AS w, unnest(range(4)) AS k)""")
def ca04_offers(spark, d):
    """Two listings for each part. By its number: the first one's page is gone, its title or price is refused, nothing
    is wrong, its price is far from what is expected and a second run finds another, or finds none."""
    one, two = stored(part_pages(spark, d, "first item"), "first"), stored(part_pages(spark, d, "second item", 1), "second")
    case = F.col("p_partkey") % 5
    both = one.join(two.select("p_partkey", F.col("card").alias("other")), "p_partkey")
    with measured_joins(spark):
        pages = stored(_capture(both, 0, "serp", "search", F.concat(F.lit("<html>"), "card", "other", F.lit("</html>"))), "captures")
    pages = pages.unionByName(_capture(one, 1, "pdp", "url", F.col("html"), F.when(case == 0, 404).otherwise(200))).unionByName(_capture(two, 2, "pdp", "url", F.col("html")))
    money = lambda c: c.cast("decimal(38,10)")
    asked = _asked_parts(spark, d)
    with measured_joins(spark):
        wanted = stored(one.select("p_partkey", "website", "name").join(asked.withColumnRenamed("query_id", "p_partkey"), "p_partkey").withColumn("odd", F.col("p_partkey") % 2 == 1), "wanted")
    refused = wanted.where((case == 1) & F.col("odd"))
    titles = refused.select(F.col("user_query").alias("expected"), F.col("name").alias("scraped"), F.lit(False).alias("match")).distinct()
    # a refusal is of a question and a title: parts of the same name whose first page is not to be refused are asked for in other words
    plans = wanted.where(~((case == 1) & F.col("odd"))).select(F.col("p_partkey").alias("query_id"), "website", F.col("user_query").alias("search_query"), F.concat("user_query", F.lit(" item")).alias("match_query"))
    far = one.where(case >= 3).select(F.col("p_partkey").alias("query_id"), "website", money(F.col("price") * 2).alias("ref_price"))
    prices = one.where((case == 1) & (F.col("p_partkey") % 2 == 0)).select("website", F.col("name").alias("title"), money(F.col("price")).alias("price"), F.lit(False).alias("plausible")).distinct()
    again = one.where(case == 3).select(F.col("p_partkey").alias("query_id"), "website", F.col("name").alias("title"), money(F.col("price") + 7).alias("price"), F.lit("Success").alias("status"), F.lit("http").alias("method"), "url")
    rows = comparison.compare(asked, plans, pages, far, titles, prices, second=again)
    return rows.select("query_id", "website", "status", F.col("price").cast("double").alias("price"))


@query("UD-09_stage_counts", """
    WITH n AS (SELECT count(*) AS n FROM part)
    SELECT CAST(position AS INTEGER) AS position, stage, metric, k * n AS value FROM n, (VALUES
        (0, 'planned', 'rows', 4), (1, 'candidates', 'rows', 1), (1, 'candidates', 'gone', 0), (1, 'candidates', 'skipped', 0), (1, 'candidates', 'refused', 0), (2, 'matched', 'rows', 1),
        (3, 'fields', 'rows', 1), (3, 'fields', 'rejected', 0), (4, 'rows', 'rows', 4), (4, 'rows', 'succeeded', 1), (4, 'rows', 'outliers', 0)) AS v(position, stage, metric, k)""")
def ud09(spark, d):
    """What each stage of the whole plan gave, counted while it ran."""
    seen = Hooks()
    _compared_parts(spark, d, seen).write.format("noop").mode("overwrite").save()
    return seen.table(spark)


@query("JS-03_products_of_parts", "SELECT p_partkey * 4 + 1 AS page_id, p_name || ' ' || p_brand || ' ' || p_type || ' item' AS title, round(p_retailprice, 2) AS price FROM part")
def js03_parts(spark, d):
    """The first full product of every product page."""
    pages = html.page_facts(part_captures(spark, d).where("kind = 'pdp'").select("page_id", "html"), ["page_id"])
    found = pages.withColumn("found", html.first_ld_product())
    return found.select("page_id", "found.title", F.col("found.price").cast("double").alias("price"))


@query("UD-01_serp_tables", """
    SELECT p_partkey * 4 AS page_id, ['Amazon.com', 'BestBuy.com', 'Walmart.com', 'Newegg.com'][p_partkey % 4 + 1] AS website, 1 AS rank, p_name || ' ' || p_brand || ' ' || p_type || ' item' AS title FROM part""")
def ud01_tables(spark, d):
    """Search pages by the table function of their retailer."""
    pages = stored(part_captures(spark, d).where("kind = 'serp'").select("page_id", "website", "url", "html"), "captures")
    return html.serp(pages, extract=extractors.serp_facts).select("page_id", "website", "rank", "title")


@query("CA-05_price_check", "SELECT l_orderkey, CASE WHEN min(l_linenumber) FILTER (l_discount < 0.05) IS NULL THEN 'Failed' ELSE 'Success' END AS status FROM lineitem GROUP BY 1")
def ca05(spark, d):
    tries = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("try_order"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") < 0.05).alias("passes"))
    return cascade.price_checked(tries, ["l_orderkey"]).select("l_orderkey", "status")


@query("CA-08_finalise", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 1 THEN NULL ELSE p_name END AS title FROM part")
def ca08(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.lit("u").alias("url"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("price"), F.lit("Success").alias("status"), (F.col("p_size") % 2 == 0).alias("known"))
    return cascade.finalised(p).select("p_partkey", "status", "title")


@query("CA-09_always_a_row", "SELECT s_suppkey AS query_id, w AS website, CASE WHEN w = 'Amazon.com' AND s_acctbal > 0 THEN 'Success' ELSE 'Failed' END AS status FROM supplier, (SELECT unnest(['Amazon.com', 'BestBuy.com', 'Walmart.com', 'Newegg.com']) AS w)")
def ca09(spark, d):
    s = table(spark, d, "supplier")
    planned = cascade.planned(s.select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("user_query")), tables.retailers(spark), spark.createDataFrame([], "query_id bigint, website string, search_query string, match_query string"))
    done = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("query_id"), F.lit("Amazon.com").alias("website"), F.lit("Success").alias("status"), F.lit("http").alias("method"))
    return cascade.always(planned, done).select("query_id", "website", "status")


@query("CA-10_second_pass", """
    SELECT o_orderkey AS query_id, CASE WHEN abs(o_totalprice - r) / r <= 0.2 THEN o_totalprice WHEN o_orderstatus <> 'P' THEN o_totalprice + 1 END AS price,
        CASE WHEN abs(o_totalprice - r) / r > 0.2 AND o_orderstatus = 'P' THEN 'Failed' ELSE 'Success' END AS status
    FROM (SELECT *, (SELECT avg(o_totalprice) FROM orders) AS r FROM orders)""")
def ca10(spark, d):
    """Outliers take what a second run found, which found nothing for some."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit("Amazon.com").alias("website"), F.col("o_totalprice").alias("price"), F.lit("Success").alias("status"), "o_orderstatus")
    references = o.select("query_id", "website").crossJoin(F.broadcast(o.agg(F.avg("price").alias("ref_price"))))
    again = o.where("o_orderstatus <> 'P'").select("query_id", "website", (F.col("price") + 1).alias("price"), "status")
    return cascade.second_pass(o.drop("o_orderstatus"), references, again).select("query_id", "price", "status")


@query("CA-11_extended_searches", "SELECT CAST(query_id AS INTEGER) AS query_id, n FROM " + values([(1, 4), (2, 3), (3, 1)], "query_id, n"))
def ca11(spark, d):
    q = spark.createDataFrame([(1, "Lenovo Tab P12"), (2, "MacBook"), (3, "toaster")], "query_id int, user_query string")
    return q.withColumn("norm", text.normalized("user_query")).select("query_id", F.size(tables.more_searches()).alias("n"))


@query("WN-06_fallback_scores")
def wn06(spark, d):
    listings = formed_pairs(spark, d).withColumn("rank", F.lit(1)).withColumn("website", F.lit("Amazon.com")).withColumn("query_id", F.col("pair_id"))
    return matching.candidates(listings).select("pair_id", "score", "fallback")
