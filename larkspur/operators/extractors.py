"""Extractors of search pages as table functions, one for each retailer, for lateral joins and for SQL.

    SELECT p.page_id, r.* FROM pages p, LATERAL serp_amazon(p.page_id, p.url, p.html) r

Each gives the listing rows of one page as ``html.serp_facts`` does, with the key in
the type that it comes in, whatever that is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import html

#: Columns of a listing row.
FACTS = {
    "path": IntegerType(), "pos": IntegerType(), "title": StringType(), "href": StringType(), "link": StringType(),
    "sponsored": BooleanType(), "strict": BooleanType(),
}


class Extractor:
    """What the retailers' table functions share; ``website`` says whose pages they read."""

    website = ""

    @staticmethod
    def analyze(page_id: AnalyzeArgument, url: AnalyzeArgument, html: AnalyzeArgument) -> AnalyzeResult:
        out = StructType().add("page_id", page_id.dataType)
        for name, kind in FACTS.items():
            out = out.add(name, kind)
        return AnalyzeResult(out)

    def eval(self, page_id, url, html_text):
        for row in html.page_listings(self.website, url, html_text):
            yield (page_id, *row)


class Amazon(Extractor):
    website = "Amazon.com"


class BestBuy(Extractor):
    website = "BestBuy.com"


class Walmart(Extractor):
    website = "Walmart.com"


class Newegg(Extractor):
    website = "Newegg.com"


#: Table functions by the name that SQL knows them by.
TABLES = {"serp_amazon": Amazon, "serp_bestbuy": BestBuy, "serp_walmart": Walmart, "serp_newegg": Newegg}


def register(spark: SparkSession) -> list[str]:
    """Make the extractors known to SQL; their names."""
    for name, extractor in TABLES.items():
        spark.udtf.register(name, udtf(extractor))
    return list(TABLES)


def serp_facts(pages: DataFrame) -> DataFrame:
    """As ``html.serp_facts``, by a lateral join of each retailer's pages with its table function."""

    def of(extractor: type[Extractor]) -> DataFrame:
        own = pages.where(F.col("website") == extractor.website)
        listed = udtf(extractor)(*(F.col(c).outer() for c in ("page_id", "url", "html")))
        return own.lateralJoin(listed.select(*FACTS)).drop("html")

    return reduce(DataFrame.unionByName, map(of, TABLES.values()))
