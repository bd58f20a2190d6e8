"""Functions against examples worked out by hand, and properties of similarity."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import fuzzy, parse, text, urls
from larkspur.sources.settings import Settings


def one(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in sorted(rows.select("i", column("s").alias("x")).collect())]


def test_price(spark):
    got = one(spark, ["$1,234.56", "1.234,56", "$10 - $20", "$542.00$1,496.00", "-5", ".5", "5.", "$0.00", "1.2.3", "", None], parse.price)
    want = ["1234.56", "1.23456", "1020", None, "5", "0.5", "5", None, None, None, None]
    assert got == [None if w is None else Decimal(w) for w in want]


def test_rating_and_count(spark):
    assert one(spark, ["4.5 out of 5", "47", "1,234 ratings", "51", "", None], parse.rating) == [4.5, 4.7, 1.234, None, None, None]
    assert one(spark, ["1,234 ratings", "4.5 out of 5 stars 1,234 ratings", "no reviews", ","], parse.review_count) == [1234, 4, None, None]


def test_display(spark):
    rows = spark.createDataFrame([(1234.5, 4.25, 1234), (None, 4.35, None)], "p double, r double, n bigint")
    got = rows.select(parse.shown_price(F.col("p").cast("decimal(18,2)")), parse.shown_rating("r"), parse.shown_count("n")).collect()
    assert [tuple(g) for g in got] == [("$1,234.50", "4.2", "1,234"), ("N/A", "4.3", "N/A")]


def test_normal_form(spark):
    got = one(spark, ["Café Déjà 14-inch M5 (2024) 256GB", 'MacBook 14" Pro', "lenovo tab p12-2024", "macbook pro 14 m5 256gb", "tab p12-2024 2080 ti 1999x"], text.normal_form)
    assert got[0].normalized == "cafe deja 14-inch m5 2024 256gb"
    assert got[1].normalized == "macbook 14 pro"
    assert got[2].model_tokens == ["p12", "2024"]
    assert got[3].model_tokens == ["m5"]
    assert got[4].years == ["2024", "2080"]


def test_slugs_and_condition(spark):
    assert one(spark, ["  Sony WH-1000XM5! & más_x ", "!!!"], text.log_slug) == ["sony-wh-1000xm5-más-x", "query"]
    assert one(spark, ["BestBuy.com", "A b.c", "!"], text.site_slug) == ["bestbuycom", "a_bc", "site"]
    assert one(spark, ["Used, good", "unused item", "open box"], text.is_non_new) == [True, False, True]


def test_urls(spark):
    rows = spark.createDataFrame([("6551465", "bestbuy.com"), ("Item=N82E16834156463", "newegg.com"), ("https://www.bestbuy.com/site/sony?skuId=1234567", "bestbuy.com"), ("https://www.walmart.com/ip/tv/123456789", "walmart.com"), (None, "amazon.com")], "url string, domain string")
    got = [r.url for r in urls.coerced(rows).collect()]
    assert got == ["https://www.bestbuy.com/site/product/6551465.p", "https://www.newegg.com/Product.aspx?Item=N82E16834156463", "https://www.bestbuy.com/site/sony/1234567.p", "https://www.walmart.com/ip/tv/123456789", ""]
    assert one(spark, ["12345678", "111111111", "123456789", "731473988"], urls.made_up_item) == [True, True, True, False]
    assert one(spark, ["https://www.bestbuy.com/site/a-65inch-O2X-pro/6551465.p", "https://www.bestbuy.com/site/6551465"], urls.bestbuy_title) == ["A 65Inch O2X Pro", "Best Buy SKU 6551465"]


@pytest.mark.parametrize(("a", "b", "n"), [("kitten sitting", "sitting kitten", 9), ("abc", "abc", 3), ("abc", "xyz", 0), ("", "x", 0)])
def test_lcs(a, b, n):
    assert fuzzy.lcs(a, b) == n == fuzzy.lcs(b, a)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


WORDS = st.text(alphabet="abc d", max_size=14)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_similarity_properties(a, b):
    assert fuzzy.lcs(a, b) == slow_lcs(a, b)
    for f in (fuzzy.ratio, fuzzy.token_sort, fuzzy.token_set, fuzzy.partial, fuzzy.wratio):
        assert 0 <= f(a, b) <= 100
    assert fuzzy.ratio(a, a) == 100
    assert fuzzy.token_set(a, b) == fuzzy.token_set(b, a)


def test_settings():
    s = Settings.from_env({"PRICE_GAP_RESCRAPE": "off", "MIN_MATCH_SCORE_SOFT_FLOOR": "60", "PRICE_GAP_RESCRAPE_THRESHOLD": "x", "PAGE_SETTLE_MIN_S": "9", "PAGE_SETTLE_MAX_S": "2"})
    assert (s.price_gap_enabled, s.soft_floor, s.price_gap, s.settle_min_s, s.settle_max_s) == (False, 47.9, 0.2, 2.0, 9.0)
