"""Ordered fallbacks, second passes and the shape of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, parse, text
from ..functions.text import C, col
from . import filters, matching

FIELDS = ["title", "price", "average_rating", "review_count"]


def first_success(staged: DataFrame, keys: list[str], order: str = "stage", keep: list[str] | None = None) -> DataFrame:
    """The valid row of the least stage of each key; map-side, so a key's rows never meet in full."""
    keep = keep or [c for c in staged.columns if c not in keys and c != "reject_reason"]
    best = staged.where(F.col("reject_reason").isNull()).groupBy(*keys).agg(F.min_by(F.struct(*keep), order).alias("__best"))
    return best.select(*keys, "__best.*")


def first_stage(rows: DataFrame, keys: list[str], order: str = "stage") -> DataFrame:
    """All rows of the least stage that has any, for each key."""
    return rows.withColumn("__least", F.min(order).over(Window.partitionBy(*keys))).where(F.col(order) == F.col("__least")).drop("__least")


def planned(queries: DataFrame, retailers: DataFrame, plans: DataFrame) -> DataFrame:
    """A row for each query and retailer, with its plan or the query itself."""
    each = queries.crossJoin(F.broadcast(retailers)).join(plans.select("query_id", "website", F.col("search_query").alias("__s"), F.col("match_query").alias("__m")), ["query_id", "website"], "left")
    return each.select(*[c for c in each.columns if not c.startswith("__")], F.coalesce("__s", "user_query").alias("search_query"), F.coalesce("__m", "user_query").alias("match_query"))


def always(planned_rows: DataFrame, results: DataFrame) -> DataFrame:
    """The result of every planned row; missing ones failed."""
    keys = ["query_id", "website"]
    out = planned_rows.select(*keys, "site_order").join(results, keys, "left")
    return out.withColumn("status", F.coalesce("status", F.lit("Failed"))).withColumn("method", F.when(F.col("status") == "Success", F.coalesce("method", F.lit("N/A"))).otherwise("N/A"))


def status(title: C, price: C) -> Column:
    return F.when(col(title).isNotNull() & (col(title) != "") & col(price).isNotNull(), "Success").otherwise("Failed")


def has_price() -> Column:
    return F.coalesce((F.col("status") == "Success") & F.col("price").isNotNull(), F.lit(False))


def enough_prices(rows: DataFrame, keys: list[str], least: int = fixed.ENOUGH_PRICES) -> DataFrame:
    """How many rows of each key have a price, of how many, and whether that is enough."""
    n = F.count_if(has_price())
    return rows.groupBy(*keys).agg(n.alias("success_count"), F.count(F.lit(1)).alias("total_sites"), (n >= least).alias("ok"))


def with_site_order(rows: DataFrame, retailers: DataFrame) -> DataFrame:
    """Rows with the place of their retailer among all; unknown ones come last."""
    known = F.broadcast(retailers.select("website", "site_order"))
    return rows.join(known, "website", "left").withColumn("site_order", F.coalesce("site_order", F.lit(99)))


def output_order(rows: DataFrame, group: list[str]) -> DataFrame:
    """``place`` of each row among those of its query: by ``site_order``, unknown retailers last, then by the other key ``tie``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.coalesce("site_order", F.lit(99)), "tie")))


def display_order(by: str, group: list[str], tie: str, descending: bool = False) -> Column:
    """Place of a row within what is shown together, by one column either way; rows without a value come last both ways."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return F.row_number().over(Window.partitionBy(*group).orderBy(order, tie))


def not_tried(candidates: DataFrame, tried: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose address has not been tried."""
    return candidates.join(tried.select(*keys), keys, "left_anti")


def finalised(rows: DataFrame) -> DataFrame:
    """Success without a price fails; a known page keeps its title and address."""
    bad = (F.col("status") == "Success") & F.col("price").isNull()
    keep = F.coalesce(F.col("known"), F.lit(False))
    out = rows.withColumn("__bad", bad)
    for c in ("title", "url"):
        out = out.withColumn(c, F.when(~F.col("__bad") | keep, F.col(c)))
    return out.withColumn("status", F.when(F.col("__bad"), "Failed").otherwise(F.col("status"))).drop("__bad")


def rechecked(rows: DataFrame) -> DataFrame:
    """Rows whose extracted title is an accessory or another model failed."""
    wrong = filters.accessory(F.col("query_form"), F.col("title_form")) | filters.model(F.col("query_form"), F.col("title_form"), "url")
    return rows.withColumn("status", F.when(F.coalesce(wrong, F.lit(False)), "Failed").otherwise(F.col("status")))


def price_checked(tries: DataFrame, keys: list[str]) -> DataFrame:
    """The first try that passes the price check; keys without one failed."""
    passing = first_success(tries.withColumn("reject_reason", F.when(~F.col("passes"), "price")), keys, "try_order", ["try_order", "price"])
    return tries.select(*keys).distinct().join(passing, keys, "left").withColumn("status", F.when(F.col("try_order").isNull(), "Failed").otherwise("Success"))


def gap_outliers(rows: DataFrame, references: DataFrame, threshold: float, keys: list[str] = matching.GROUP) -> DataFrame:
    """Rows whose price is further from its reference than the threshold, strictly."""
    joined = rows.where(F.col("price") > 0).join(references.where(F.col("ref_price") > 0), keys)
    return joined.withColumn("gap", parse.gap("price", "ref_price")).where(F.col("gap") > threshold)


def upserted(rows: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(again.select(*keys), keys, "left_anti").unionByName(again.select(*rows.columns))


def second_pass(rows: DataFrame, references: DataFrame, again: DataFrame, threshold: float = fixed.PRICE_GAP) -> DataFrame:
    """Rows with the outliers among them replaced by what a second run gave; an outlier that it has nothing for failed.

    Without a reference a row is no outlier, and what the second run says is
    not looked at.
    """
    keys = ["query_id", "website"]
    far = gap_outliers(rows, references, threshold).select(*keys)
    kept = rows.select(*keys, *[c for c in rows.columns if c not in again.columns and c != "status"]).join(far, keys)
    redone = kept.join(again, keys, "left")
    if "status" in rows.columns:
        redone = redone.withColumn("status", F.coalesce("status", F.lit("Failed")) if "status" in again.columns else F.when(F.col("price").isNull(), "Failed").otherwise("Success"))
    return upserted(rows, redone, keys)


def display(rows: DataFrame) -> DataFrame:
    """Rows as they are shown, all strings."""
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A"))
    return rows.withColumn("product_title", shown("title")).withColumn("price_shown", parse.shown_price("price")).withColumn("rating_shown", parse.shown_rating("average_rating")).withColumn("reviews_shown", parse.shown_count("review_count"))


def responses(rows: DataFrame) -> DataFrame:
    """One row for each query: its rows in site order, how many have a price, of how many.

    A query has as many rows as there are retailers, so the list is small.
    """
    row = F.struct("site_order", "website", "title", "price", "average_rating", "review_count", "status", "method", has_price().alias("has_price"))
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.count_if(has_price()).alias("success_count"), F.count(F.lit(1)).alias("total_sites"))


def unscored_sanity(query: C, serp_title: C, title: C, token_set: Column) -> Column:
    """Whether an extracted title is far from the query though it is not the listing's, or is not new."""
    other = F.trim(col(title)) != F.trim(col(serp_title))
    return (other & (token_set < 30)) | (~text.asks_for_used(query) & text.is_non_new(title))


def safe_pick(listings: DataFrame, group: list[str] = matching.GROUP) -> DataFrame:
    """The first listing of a page, in page order, that is not to be skipped and was verified."""
    skip = filters.skip_candidate("query", F.col("query_form"), "title", F.col("title_form"), "url") | filters.model(F.col("query_form"), F.col("title_form"), "url")
    return matching.keep_first(listings.where(~skip & F.col("match")), group, ["rank"])
