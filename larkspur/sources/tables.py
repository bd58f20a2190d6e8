"""Input tables and how they are read: retailers, catalogue, captures, hosted responses, recorded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, parse, text, urls
from ..operators import filters, matching

# Known product pages: domain, pattern that the normalised query has, pattern that it must not have, title, URL.
KNOWN_PAGES = [
    ("bestbuy.com", r"tab\s*p\s*12|\bp12\b", None, "Lenovo Tab P12 with Lenovo Tab Pen Plus ZACH0165US Storm Grey", "https://www.bestbuy.com/site/lenovo-tab-p12-with-lenovo-tab-pen-plus-zach0165us-storm-grey/6551465.p"),
    ("newegg.com", r"tab\s*p\s*12|\bp12\b", None, "Lenovo Tab P12-2024 Expansive Touchscreen Tablet 12.7 3K 128GB", "https://www.newegg.com/p/3C6-0002-009C6"),
    ("newegg.com", r"macbook\s+pro", r"\bm[5-9]\b", "Refurbished Apple MacBook Pro (2021) 14-inch - Apple M1 Max chip: 10-Core CPU/32-Core GPU - 2TB - Space Grey - 64GB RAM", "https://www.newegg.com/apple-14-space-grey/p/2SN-0001-03GV5"),
    ("amazon.com", r"bose.*quietcomfort.*ultra|qc\s*ultra", None, "Bose QuietComfort Ultra Wireless Noise Cancelling Headphones", "https://www.amazon.com/dp/B0CCZ1L489"),
    ("bestbuy.com", r"bose.*quietcomfort.*ultra|qc\s*ultra", None, "Bose QuietComfort Ultra Wireless Noise Cancelling Over-the-Ear Headphones", "https://www.bestbuy.com/site/bose-quietcomfort-ultra-wireless-noise-cancelling-over-the-ear-headphones-lunar-blue/6577011.p"),
    ("amazon.com", r"oled65c4pua|oled\s*evo\s*c4.*65|65.*oled\s*evo\s*c4", None, "LG 65-Inch Class OLED evo C4 Series Smart TV 4K OLED65C4PUA", "https://www.amazon.com/LG-65-Inch-Processor-AI-Powered-OLED65C4PUA/dp/B0CVS18PH9"),
]

# More search strings by pattern of the normalised query; {} is the query.
MORE_SEARCHES = [
    (r"tab\s*p\s*12|\bp12\b", ["Lenovo Tab P12 tablet", "{} ZACH0165US", "Lenovo Tab P12-2024 tablet 256GB"]),
    (r"macbook|m5\b", ["Apple MacBook Pro 14 M5", "{} Apple MacBook Pro"]),
]

# Names of retailers in model answers, most telling first.
SITE_ALIASES = [("Amazon.com", 0, "amazon"), ("BestBuy.com", 0, "bestbuy"), ("Walmart.com", 0, "walmart"), ("Newegg.com", 0, "newegg")]


def retailers(spark: SparkSession) -> DataFrame:
    """Four rows: site_order, website, domain, search_prefix."""
    return spark.createDataFrame(fixed.RETAILERS, "site_order int, website string, domain string, search_prefix string")


def asked(queries: DataFrame) -> DataFrame:
    """Queries trimmed, blank ones and those beyond 500 characters away."""
    q = F.trim("user_query")
    return queries.withColumn("user_query", q).where((F.length("user_query") > 0) & (F.length("user_query") <= 500))


def known_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_PAGES, "domain string, include_re string, exclude_re string, title string, url string")


def discovered(found: DataFrame) -> DataFrame:
    """What a search of the web found, ``(query_id, website, domain, title, url)``, as listings of rank 1 where it is a product's address."""
    rows = urls.coerced(found.withColumn("url", F.trim("url")).withColumn("title", F.trim("title")))
    best_buy = (F.col("domain") == "bestbuy.com") & F.contains(F.lower("url"), F.lit("/product/"))
    good = (F.col("title") != "") & F.startswith("url", F.lit("http")) & (urls.is_product("url", "domain") | best_buy)
    return rows.where(good).withColumn("rank", F.lit(1)).withColumn("url", urls.without_fragment("url"))


def in_catalogue(rows: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose address is one of ``known``, without regard to case, query and fragment."""
    key = lambda c: F.lower(urls.canonical(c))
    return rows.withColumn("__key", key(url)).join(known.select(key("url").alias("__key")), "__key", "left_semi").drop("__key")


def catalogued(queries: DataFrame, keep: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Known pages for each query: a theta join with six rows, by the patterns."""
    norm = queries.withColumn("norm", text.normalized("user_query"))
    known = F.broadcast(known_pages(queries.sparkSession))
    hit = F.regexp_like("norm", F.concat(F.lit("(?i)"), "include_re")) & F.coalesce(~F.regexp_like("norm", F.concat(F.lit("(?i)"), "exclude_re")), F.lit(True))
    return norm.join(known, hit).select(*keep, "domain", F.lit(1).alias("rank"), "title", "url")


def more_searches(query: str = "user_query", norm: str = "norm") -> Column:
    """The query and its variants by its normalised form, distinct without regard to case, in order."""
    norm = F.col(norm)
    out = F.array(F.trim(F.col(query)))
    for pattern, variants in MORE_SEARCHES:
        more = F.array(*(F.replace(F.lit(v), F.lit("{}"), F.col(query)) for v in variants))
        out = F.when(norm.rlike(f"(?i){pattern}"), F.concat(out, more)).otherwise(out)
    return distinct_strings(out)


def distinct_strings(values: Column) -> Column:
    """Trimmed strings, empty ones away, the first of each spelling without regard to case."""
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    low = F.transform(trimmed, F.lower)
    return F.filter(trimmed, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def usable_captures(captures: DataFrame) -> DataFrame:
    """Captured pages that were really served: status below 400 and no robot check."""
    return captures.where(F.coalesce(F.col("http_status") < 400, F.lit(True)) & ~filters.bot_page("html", "website"))


def hosted_serp(bodies: DataFrame) -> DataFrame:
    """Hosted search extracts ``(page_id, domain, body)``: admitted rows of the JSON, ranks with gaps, fifteen at most."""
    rows = F.from_json("body", "results array<struct<title:string,url:string>>")["results"]
    r = bodies.select("page_id", "domain", F.posexplode(rows).alias("pos", "r")).select("page_id", "domain", (F.col("pos") + 1).alias("rank"), F.trim("r.title").alias("title"), F.col("r.url").alias("url"))
    r = urls.coerced(r)
    good = (F.col("title") != "") & F.startswith("url", F.lit("http")) & urls.is_product("url", "domain") & urls.plausible("url", "domain")
    return r.where(good & (F.col("rank") <= fixed.MAX_SERP_ROWS))


def hosted_fields(bodies: DataFrame) -> DataFrame:
    """Hosted product extracts ``(page_id, body)`` to fields and the reason why they are not valid."""
    j = F.from_json("body", "title string, price string, average_rating string, review_count string")
    f = bodies.select("page_id", j["title"].alias("title"), parse.coerced_price(j["price"]).alias("price"), parse.rating(j["average_rating"]).alias("average_rating"), parse.review_count(j["review_count"]).alias("review_count"))
    return f.withColumn("reject_reason", parse.reject_reason("title", "price", "average_rating", "review_count"))


def model_serp(bodies: DataFrame) -> DataFrame:
    """Model-read search pages ``(page_id, domain, body)``: a JSON list of title and url."""
    return matching.keep_first(hosted_serp(bodies).withColumn("url", urls.without_query("url")), ["page_id", "url"], ["rank"])


def recorded_run(spark: SparkSession, path: str) -> DataFrame:
    """A recorded response (one JSON document: ``query`` and ``result`` with ``rows``) as its rows, in order."""
    run = spark.read.json(path, multiLine=True)
    return run.select("query", F.posexplode("result.rows").alias("pos", "row")).select("query", "pos", "row.*")


def price_blob(body: str) -> Column:
    """The map of prices in a model answer: the whole of it if it names all retailers, else what is wrapped in it, else the whole."""
    v = F.try_parse_json(body)
    whole = F.forall(F.array(*(F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for _, _, k in SITE_ALIASES)), lambda x: x)
    wrapped = [F.try_variant_get(v, f"$.{w}", "map<string,variant>") for w in ("prices", "retailers", "results", "data")]
    return F.coalesce(F.when(whole, F.try_variant_get(v, "$", "map<string,variant>")), *wrapped, F.try_variant_get(v, "$", "map<string,variant>"))


def answered_prices(answers: DataFrame) -> DataFrame:
    """Model answers ``(query_id, body)`` to a reference price for each retailer (null where there is none)."""
    entries = answers.select("query_id", F.explode(price_blob("body")).alias("k", "v")).select("query_id", text.key("k").alias("alias"), parse.coerced_price(F.try_variant_get("v", "$", "string")).alias("ref_price"))
    site = F.create_map(*(F.lit(x) for s, _, a in SITE_ALIASES for x in (a, s)))
    named = entries.withColumn("website", F.try_element_at(site, F.col("alias"))).where(F.col("website").isNotNull())
    found = named.groupBy("query_id", "website").agg(F.max("ref_price").alias("ref_price"))
    each = answers.select("query_id").distinct().join(F.broadcast(retailers(answers.sparkSession).select("website")))
    return each.join(found, ["query_id", "website"], "left")


def answered_plans(answers: DataFrame) -> DataFrame:
    """Model answers ``(query_id, user_query, body)`` to search and match strings for each retailer."""
    v = F.try_parse_json("body")
    entries = answers.select("query_id", F.explode(F.try_variant_get(v, "$", "map<string,variant>")).alias("k", "v"))
    pick = lambda *names: F.trim(F.coalesce(*(F.nullif(F.try_variant_get("v", f"$.{n}", "string"), F.lit("")) for n in names), F.lit("")))
    plain = F.when(F.schema_of_variant("v") == "STRING", F.trim(F.try_variant_get("v", "$", "string")))
    entries = entries.select("query_id", text.key("k").alias("alias"), F.coalesce(plain, pick("search_query", "search", "query")).alias("s"), F.coalesce(plain, pick("product_name", "product", "name", "title")).alias("p"))
    site = F.create_map(*(F.lit(x) for s, _, a in SITE_ALIASES for x in (a, s)))
    named = entries.withColumn("website", F.try_element_at(site, F.col("alias"))).where(F.col("website").isNotNull())
    first = named.groupBy("query_id", "website").agg(F.min_by(F.struct("s", "p"), "alias").alias("e"))
    rows = answers.select("query_id", "user_query").join(F.broadcast(retailers(answers.sparkSession).select("website"))).join(first, ["query_id", "website"], "left")
    s, p = F.nullif("e.s", F.lit("")), F.nullif("e.p", F.lit(""))
    return rows.select("query_id", "website", "user_query", F.coalesce(s, p, "user_query").alias("search_query"), F.coalesce(p, s, "user_query").alias("match_query"))
