"""URLs of retailers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import C, col, has_any



def host(url: C) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("AUTHORITY")), F.lit("")))


def path(url: C) -> Column:
    return F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))


def query_string(url: C) -> Column:
    return F.coalesce(F.try_parse_url(col(url), F.lit("QUERY")), F.lit(""))


def search_url(prefix: C, query: C) -> Column:
    """The retailer's search page; escapes as form encoding does, but for * and ~."""
    encoded = F.replace(F.replace(F.url_encode(F.trim(col(query))), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(col(prefix), encoded)


def normal(url: C) -> Column:
    u = F.regexp_replace(F.trim(col(url)), "^//", "https://")
    u = F.regexp_replace(u, r"^http://(www\.(?:bestbuy|newegg|amazon|walmart)\.com)", "https://$1")
    return F.regexp_replace(u, r"^https?://bestbuy\.com", "https://www.bestbuy.com")


def same_domain(url: C, domain: C) -> Column:
    return F.contains(host(url), F.lower(col(domain)))


def without_query(url: C) -> Column:
    return F.split_part(col(url), F.lit("?"), F.lit(1))


def without_fragment(url: C) -> Column:
    return F.split_part(col(url), F.lit("#"), F.lit(1))


def canonical(url: C) -> Column:
    """No query, fragment or final slashes."""
    return F.regexp_replace(without_fragment(without_query(url)), "/+$", "")


def product_link(url: C) -> Column:
    """The address of a shown product, where there is one to follow."""
    return F.when(F.startswith(col(url), F.lit("http")), col(url))


def asin(url: C) -> Column:
    return F.nullif(F.upper(F.regexp_extract(col(url), "(?i)/dp/([A-Z0-9]{10})", 1)), F.lit(""))


def has_asin(href: C, wanted: C) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(href), F.lit("")), F.lit("(?i)/(?:dp|gp/product)/([A-Z0-9]{10})"), 1)
    return F.array_contains(F.transform(found, F.upper), F.upper(col(wanted)))


def attribute_asin(value: C) -> Column:
    v = F.trim(F.coalesce(col(value), F.lit("")))
    return F.when(v.rlike("^[A-Za-z0-9]{10}$"), F.upper(v))


def is_block_page(url: C) -> Column:
    return F.lower(F.coalesce(col(url), F.lit(""))).rlike("/blocked|validatecaptcha|/bot-mitigation")


def newegg_segment(url: C) -> Column:
    """The product's segment of a path, or its item number; null for search pages."""
    p, low = path(url), F.lower(path(url))
    seg = F.regexp_extract(p, "(?i)/p/([A-Z0-9][A-Z0-9-]{3,})", 1)
    item = F.regexp_extract(query_string(url), "(?i)item=([A-Z0-9-]{6,})", 1)
    searched = F.endswith(low, F.lit("/p/pl")) | F.contains(low, F.lit("/p/pl/"))
    return F.when(~searched, F.coalesce(F.nullif(F.when(F.lower(seg) != "pls", seg), F.lit("")), F.nullif(item, F.lit(""))))


def bestbuy_pdp(url: C) -> Column:
    p, low = path(url), F.lower(path(url))
    sku = p.rlike(r"(?i)/[0-9]{6,}(\.p)?(/|$|\?)")
    site = F.contains(p, F.lit("/site/")) & ~F.contains(low, F.lit("searchpage.jsp")) & ~F.contains(low, F.lit("/site/compare/"))
    return same_domain(url, F.lit("bestbuy.com")) & (F.contains(low, F.lit("/product/")) | (site & (F.contains(p, F.lit(".p")) | sku)))


def is_product(url: C, domain: C) -> Column:
    """Whether a URL of the retailer with that domain names a product."""
    u, d = col(url), col(domain)
    amazon = F.contains(u, F.lit("/dp/")) | F.contains(u, F.lit("/gp/product/"))
    return F.coalesce(
        F.when(d == "amazon.com", same_domain(u, d) & amazon)
        .when(d == "bestbuy.com", bestbuy_pdp(u))
        .when(d == "walmart.com", same_domain(u, d) & F.contains(u, F.lit("/ip/")))
        .when(d == "newegg.com", same_domain(u, d) & newegg_segment(u).isNotNull()),
        F.lit(False),
    )


def accessory_slug(url: C) -> Column:
    return has_any(F.lower(path(url)), fixed.ACCESSORY_SLUGS)


def bestbuy_title(url: C) -> Column:
    """A title from the slug of a product page."""
    parts = F.filter(F.split(path(url), "/"), lambda p: (p != "") & (F.lower(p) != "site"))
    slug = F.regexp_replace(F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(F.get(parts, F.lit(0))), r"(?i)\.p$", "")
    # a capital begins each run of letters, also after a digit or hyphen
    spaced = F.regexp_replace(F.replace(F.lower(slug), F.lit("-"), F.lit(" ")), r"([^\p{L}]+)", "\u0001$1\u0001")
    title = F.array_join(F.transform(F.split(spaced, "\u0001"), F.initcap), "")
    return F.when(F.size(parts) == 0, "Best Buy product").when(slug.rlike("^[0-9]+$"), F.concat(F.lit("Best Buy SKU "), slug)).otherwise(F.substring(title, 1, 160))


def coerced(rows: DataFrame, url: str = "url", domain: str = "domain", search: str | None = None) -> DataFrame:
    """Rows with ``url`` as a product URL, from what a page or model gave: bare numbers, relative paths, missing endings.

    Each step is a column of its own, so that none is computed more than once.
    """
    bestbuy, newegg = F.col(domain) == "bestbuy.com", F.col(domain) == "newegg.com"
    raw, u, p = F.col("__raw"), F.col("__u"), F.col("__path")
    steps = rows.withColumn("__raw", F.trim(F.coalesce(F.col(url), F.lit(""))))
    home = F.when(bestbuy & F.startswith(raw, F.lit("/site/")), "https://www.bestbuy.com").when(newegg & raw.rlike("^/(?!/)"), "https://www.newegg.com").otherwise("")
    steps = steps.withColumn("__u", normal(F.concat(home, raw))).withColumn("__path", path("__u"))
    sku = F.regexp_extract(query_string("__u"), "(?:^|&)sku[Ii]d=([0-9]{6,})(?:&|$)", 1)
    base = F.regexp_replace(F.regexp_replace(p, "/+$", ""), "^$", "/site/product")
    has_sku = p.rlike(r"(?i)/[0-9]{6,}(\.p)?(/|$|\?)")
    steps = steps.withColumn("__sku", sku).withColumn("__given", F.when((F.col("__sku") != "") & ~F.contains(p, F.lit(".p")) & ~has_sku, F.concat(F.lit("https://www.bestbuy.com"), base, F.lit("/"), F.col("__sku"), F.lit(".p"))).otherwise(u))
    given = F.col("__given")
    bare = F.contains(given, F.lit("bestbuy.com")) & ~F.contains(given, F.lit(".p")) & given.rlike(r"(?i)^[a-z]+://[^?#]*/[0-9]{6,}(/|$|\?|#)")
    steps = steps.withColumn("__ended", F.when(bare, F.concat(F.regexp_replace(without_query(given), "/+$", ""), F.lit(".p"))).otherwise(given))
    item = F.nullif(F.regexp_extract(raw, "(?i)item=([A-Z0-9-]{6,})", 1), F.lit(""))
    segments = [F.nullif(F.regexp_extract(x, "(?i)/p/([A-Z0-9][A-Z0-9-]{3,})", 1), F.lit("")) for x in ([F.coalesce(F.col(search), F.lit(""))] if search else []) + [raw]]
    steps = steps.withColumn("__item", item).withColumn("__segment", F.coalesce(*segments))
    on_search = F.contains(F.lower(p), F.lit("/p/pl")) & F.col("__segment").isNotNull() & ~F.lower("__segment").isin("pl", "pls")
    out = (
        F.when(bestbuy & raw.rlike("^[0-9]{6,}$"), F.concat(F.lit("https://www.bestbuy.com/site/product/"), raw, F.lit(".p")))
        .when(newegg & F.col("__item").isNotNull() & ~F.contains(F.lower(u), F.lit("newegg.com")), F.concat(F.lit("https://www.newegg.com/Product.aspx?Item="), F.col("__item")))
        .when(newegg & on_search, F.concat(F.lit("https://www.newegg.com/p/"), F.col("__segment")))
        .when(bestbuy & ~p.rlike("(?i)/product/.*[^/]$"), without_fragment("__ended"))
        .otherwise(without_fragment(u))
    )
    return steps.withColumn(url, F.trim(out)).drop("__raw", "__u", "__path", "__sku", "__given", "__ended", "__item", "__segment")


def made_up_item(item: C) -> Column:
    """Item numbers that models invent: short, one digit repeated, or counted up."""
    i = col(item)
    first = F.substring(i, 1, 1).try_cast("int")
    counted = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(i) - 1, F.lit(0))), lambda k: ((first + k) % 10).cast("string")), "")
    return ~i.rlike("^[0-9]+$") | (F.length(i) < 9) | i.rlike(r"^([0-9])\1*$") | i.isin(fixed.MADE_UP_ITEM_IDS) | ((F.length(i) <= 10) & (counted == i))


def plausible(url: C, domain: C) -> Column:
    item = F.regexp_extract(col(url), "/ip/[^/]+/([0-9]+)", 1)
    return ~((col(domain) == "walmart.com") & (item != "") & made_up_item(item))


def reachable(url: C, http_status: C) -> Column:
    """Captured pages count as gone only with 404 or 410."""
    return F.coalesce(F.startswith(col(url), F.lit("http")), F.lit(False)) & F.coalesce(~col(http_status).isin(404, 410), F.lit(True))


