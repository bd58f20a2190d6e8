"""Table functions of retailers give what the parse of whole tables gives."""

from pyspark.sql import functions as F

from larkspur.operators import extractors, html
from larkspur.queries.pages import SERPS

PAGES = "page_id int, query_id int, website string, url string, html string"


def test_lateral_joins_equal_the_parse(spark):
    pages = spark.createDataFrame([*SERPS, (99, 1, "Amazon.com", None, None), (98, 1, "Other.com", "https://x", "<a href='/dp/B0AAAAAAA1'>x</a>"), (97, 1, "Newegg.com", "https://www.newegg.com/", "")], PAGES)
    names = ["page_id", "website", "url", "path", "pos", "title", "href", "link", "sponsored", "strict"]
    mine = extractors.serp_facts(pages.drop("query_id")).select(names).collect()
    assert len(mine) > 5 and sorted(map(str, mine)) == sorted(map(str, html.serp_facts(pages).where("website <> 'Other.com'").select(names).collect()))


def test_sql_with_keys_of_any_type(spark):
    spark.createDataFrame(SERPS, PAGES).createOrReplaceTempView("search_pages")
    assert extractors.register(spark) == ["serp_amazon", "serp_bestbuy", "serp_walmart", "serp_newegg"]
    by_sql = spark.sql("SELECT r.* FROM search_pages p, LATERAL serp_amazon(concat('p', p.page_id), p.url, p.html) r WHERE p.website = 'Amazon.com'")
    assert by_sql.schema["page_id"].dataType.simpleString() == "string"
    want = html.serp_facts(spark.table("search_pages").where("website = 'Amazon.com'")).select(F.concat(F.lit("p"), "page_id"), "path", "pos", "title").collect()
    assert sorted(map(tuple, by_sql.select("page_id", "path", "pos", "title").collect())) == sorted(map(tuple, want))
    spark.catalog.dropTempView("search_pages")
