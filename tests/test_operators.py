"""Operators over small tables: filters, ranking, extraction, cascades, streaming progress."""

from decimal import Decimal

from pyspark.sql import functions as F

from larkspur.operators import cascade, dom, filters, html, judge, matching
from larkspur.queries import pages
from larkspur.sources import tables
from larkspur.streaming import progress


def fires(spark, rule, cases):
    rows = filters.with_forms(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, query string, title string, want boolean"), "query", "title")
    got = rows.select("i", rule(F.col("query_form"), F.col("title_form")).alias("got"), "want").collect()
    assert [r.got for r in sorted(got)] == [r.want for r in sorted(got)]


def test_filters(spark):
    fires(spark, filters.accessory, [("apple ipad", "case for apple ipad", True), ("apple ipad", "apple ipad 256gb", False)])
    fires(spark, filters.earbuds_vs_headphones, [("bose headphones", "bose ultra earbuds", True), ("bose earbuds", "bose over-ear", True)])
    fires(spark, lambda q, t: filters.bundle(q, t, F.lit("")), [("lg 65 inch tv", "lg 65 inch tv with soundbar", True), ("lg tv soundbar", "lg tv soundbar", False)])
    fires(spark, filters.model_code, [("lenovo tab p12", "lenovo tab plus", True)])
    fires(spark, filters.chip_generation, [("macbook pro m5", "macbook pro m1", True), ("macbook m5", "m1-m5 sleeve", True), ("macbook m1", "macbook m5", False)])
    fires(spark, lambda q, t: filters.screen_size(q, t, F.lit("")), [("oled 65 inch", "oled 48 inch", True), ("oled 65 inch", "oled c4", False)])
    fires(spark, filters.year, [("tab p12 2024", "tab p12 2023", True), ("tab p12 2024", "tab p12", False)])
    fires(spark, filters.numeric_series, [("bose quietcomfort 45", "bose quietcomfort ultra", True), ("bose quietcomfort 45", "bose quietcomfort headphones", False)])


def test_scores_are_bounded_and_fall_back(spark):
    rows = [(1, "Amazon.com", 1, "sony wh-1000xm5", "Sony WH-1000XM5 Headphones", ""), (1, "Amazon.com", 2, "sony wh-1000xm5", "Case for Sony", ""), (2, "Amazon.com", 1, "tab p12", "Lenovo Tab", "https://x.com/lenovo-tab-p12/1")]
    df = filters.with_forms(spark.createDataFrame(rows, "query_id int, website string, rank int, query string, title string, url string"), "query", "title")
    got = {(r.query_id, r.rank): r for r in matching.candidates(df).collect()}
    assert set(got) == {(1, 1), (2, 1)}
    assert 48 <= got[1, 1].score <= 100 and not got[1, 1].fallback and got[2, 1].fallback


def test_dom_selectors():
    top = dom.parse("<div id='a' class='x y'><p><a href='/1'>one <b>two</b></a></p><a class='z' href='/2'>three</a><script>no</script></div>")
    assert [n.attrs["href"] for n in dom.select(top, "#a a")] == ["/1", "/2"]
    assert [n.attrs["href"] for n in dom.select(top, "div.x > a, a[href*='1']")] == ["/1", "/2"]
    assert [n.tag for n in dom.select(top, "a:not(.z)")] == ["a"]
    assert dom.visible_text(top) == "one\ntwo\nthree"
    assert dom.first(dom.parse("<p><a href=x>unclosed"), "a").text() == "unclosed"


def test_html_handles_empty_and_null(spark):
    pages_ = spark.createDataFrame([(1, "Amazon.com", "https://www.amazon.com/s", None), (2, "Newegg.com", "https://www.newegg.com/p/pl", "")], "page_id int, website string, url string, html string")
    assert html.serp(pages_).count() == 0
    assert {r.reject_reason for r in html.product_fields(pages_).collect()} == {"missing or too-short title"}


def test_comparison_has_a_row_for_each_query_and_site(spark):
    rows = pages.compared(spark).collect()
    assert [(r.query_id, r.site_order) for r in rows] == [(q, s) for q in (1, 2) for s in range(4)]
    assert rows[0].price == Decimal("348") and rows[0].price_outlier and rows[4].status == "Failed"


def test_degradations_first_cause_wins(spark):
    log = spark.createDataFrame([(2, "price verify", "b"), (1, "price verify", "a"), (3, "search plan", "c"), (4, "zzz", "d")], "seq int, component string, cause string")
    assert [(r.component, r.cause) for r in judge.degradations(log).collect()] == [("search plan", "c"), ("price verify", "a"), ("zzz", "d")]


def test_trust_rule(spark):
    rows = spark.createDataFrame([(4.8, 10000), (4.8, 9999), (5.0, None)], "r double, n bigint")
    assert [x[0] for x in rows.select(judge.trust("r", "n")).collect()] == ["Low", "Medium", "Unknown"]


def test_gap_is_strict(spark):
    rows = spark.createDataFrame([(1, "a", 120.0), (2, "a", 121.0), (3, "a", None)], "query_id int, website string, price double")
    refs = spark.createDataFrame([(i, "a", 100.0) for i in (1, 2, 3)], "query_id int, website string, ref_price double")
    assert [r.query_id for r in cascade.gap_outliers(rows, refs, 0.2).collect()] == [2]


EVENTS = [("j", 1, "start", False), ("j", 2, "site_started", False), ("j", 3, "site_finished", True), ("j", 4, "site_finished", False), ("j", 5, "site_finished", True), ("j", 6, "site_finished", True), ("j", 7, "wrapping_up", False), ("j", 8, "done", False), ("k", 1, "start", False)]
EVENT_DDL = "job_id string, seq bigint, kind string, got_price boolean"


def test_progress_in_batch(spark):
    got = progress.progress(spark.createDataFrame(EVENTS, EVENT_DDL)).where("job_id = 'j'").orderBy("seq").collect()
    assert [r.percent for r in got] == [0, 5, 27, 45, 62, 80, 95, 100]


def test_progress_as_a_stream(spark, tmp_path):
    spark.createDataFrame(EVENTS, EVENT_DDL).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.streamed_progress(spark.readStream.schema(EVENT_DDL).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("progress_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.job_id: (r.done, r.percent) for r in spark.table("progress_out").collect() if r.seq >= 0}
    assert got["j"] == (4, 100)
    assert got["k"] == (0, 0)


def test_distinct_strings(spark):
    row = spark.createDataFrame([([" a", "A ", "b", "", None, "B"],)], "v array<string>").select(tables.distinct_strings(F.col("v"))).first()
    assert row[0] == ["a", "b"]


def test_hosted_extracts(spark):
    rows = tables.hosted_serp(spark.createDataFrame(pages.BODIES, "page_id int, domain string, body string")).collect()
    assert sorted((r.page_id, r.rank, r.url) for r in rows) == [(1, 1, "https://www.walmart.com/ip/Sony/731473988"), (2, 1, "https://www.bestbuy.com/site/product/6551465.p")]
