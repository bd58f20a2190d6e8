"""Scoring listings against queries, ranking, and picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, fuzzy, text, urls
from . import filters

GROUP = ["query_id", "website"]


def score(wratio: Column, token_set: Column, recall: Column, year_bonus: Column, bundle: Column, condition: Column) -> Column:
    w = fixed.WEIGHTS
    points = w["wratio"] * wratio + w["token_set"] * token_set + w["recall"] * recall + w["year"] * year_bonus
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), points - bundle - condition))


def year_bonus(q: Column, t: Column) -> Column:
    return F.when(F.array_contains(t["years"], F.get(q["years"], F.lit(0))), 5.0).otherwise(0.0)


def listings_of(listings: DataFrame, queries: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """The listings of each query that pass its filters: an equi join on what they share, filtered before it where a side allows."""
    return listings.where(keep).join(queries, keys)


def source_rank(rows: DataFrame, values: str, name: str) -> DataFrame:
    """A row for each entry of a list, ranked by its position (from 1), with gaps where entries are dropped later."""
    rest = [c for c in rows.columns if c != values]
    return rows.select(*rest, F.posexplode(values).alias("__pos", name)).withColumn("rank", F.col("__pos") + 1).drop("__pos")


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``value`` as a list of its distinct entries for each key, in the order in which they first came."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("__at"))
    listed = F.array_sort(F.collect_list(F.struct("__at", value)))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x[value]).alias(value))


def with_scores(rows: DataFrame, candidates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows with the score of the first candidate of their address, zero where there is none."""
    first = candidates.groupBy(*keys).agg(F.min_by("score", order).alias("score"))
    return rows.join(first, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def scored(listings: DataFrame) -> DataFrame:
    """Listings ``(query, title, url, query_form, title_form, ...)`` with ``filtered`` and the score's parts.

    Similarity is computed for listings that no filter rejects; it runs over
    distinct pairs within an Arrow batch.
    """
    q, t = F.col("query_form"), F.col("title_form")
    marked = listings.withColumn("filtered", filters.reason(q, t, "url"))
    passes = F.col("filtered").isNull()
    pair = (F.when(passes, q["normalized"]), F.when(passes, t["normalized"]))
    similar = fuzzy.similarities(["wratio", "token_set"], *pair)
    marked = marked.withColumn("__similar", similar).withColumn("wratio", F.col("__similar.wratio")).withColumn("token_set", F.col("__similar.token_set")).drop("__similar")
    marked = marked.withColumn("model_recall", text.recall(q["model_tokens"], t["model_tokens"]) * 100).withColumn("year_bonus", year_bonus(q, t))
    marked = marked.withColumn("condition_penalty", text.condition_penalty("query", "title"))
    total = score(F.col("wratio"), F.col("token_set"), F.col("model_recall"), F.col("year_bonus"), text.bundle_penalty(q["normalized"], t["normalized"]), F.col("condition_penalty"))
    return marked.withColumn("score", F.when(passes, total).otherwise(0.0)).withColumn("fallback", F.lit(False))


def candidates(listings: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Scored listings that pass; where a group has none, its listings by title and path, scored by similarity alone."""
    once = scored(listings)
    passed = F.count_if(F.col("filtered").isNull()).over(Window.partitionBy(*group))
    once = once.withColumn("__passed", passed)
    first = once.where(F.col("filtered").isNull())
    again = once.where(F.col("__passed") == 0).select(*listings.columns).drop("title_form")
    again = again.withColumn("__blob", F.concat_ws(" ", "title", urls.path("url")))
    again = again.withColumn("title_form", text.normal_form("__blob")).drop("__blob")
    q, t = F.col("query_form"), F.col("title_form")
    again = again.where(filters.reason(q, t, "url").isNull()).withColumn("score", fuzzy.similarity("wratio", q["normalized"], t["normalized"])).withColumn("fallback", F.lit(True))
    return first.drop("__passed", "filtered").unionByName(again, allowMissingColumns=True)


def ranked(scored_rows: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Order within a group: score from high to low, ties in the order of the page."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "rank", "url")
    return scored_rows.withColumn("place", F.row_number().over(order))


def accept_tier() -> Column:
    """Why the best candidate is taken: its score, or its model words just below; null where it is not."""
    own = ~F.col("fallback")
    return (
        F.when(F.col("score") >= fixed.MIN_SCORE, "score")
        .when((F.col("score") >= fixed.SOFT_FLOOR) & own & (F.col("model_recall") >= 55), "soft")
        .when(own & (F.col("model_recall") >= 50) & (F.col("token_set") >= 45), "model")
    )


def best_match(scored_rows: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """The first candidate of each group, if it is acceptable."""
    return ranked(scored_rows, group).where("place = 1").withColumn("tier", accept_tier()).where(F.col("tier").isNotNull())


def first_valid(ordered: DataFrame, passes: Column, costs: Column, group: list[str] = GROUP, most: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """The first row by ``place`` that passes, within ``most`` rows that cost a check."""
    so_far = Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    tried = ordered.withColumn("__pass", passes).withColumn("__cost", F.sum(costs.cast("int")).over(so_far)).where(F.col("__cost") <= most)
    first = Window.partitionBy(*group).orderBy("place")
    return tried.where("__pass").withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__pass", "__cost", "__first")


def picked(rows: DataFrame, keys: list[str], place: str, fields: list[str], most: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """What one look through the candidates of each key gives, in the order of ``place``.

    Rows have booleans ``gone, skip, match`` (not null) and a string ``suggestion``. A
    candidate whose page is gone or that is to be skipped costs nothing; any other
    costs a check, of which there are ``most``, and is taken if it matches; if not,
    what it suggests to search for instead is noted. Returns ``keys``, ``taken`` (a
    struct of ``fields``, null where nothing was), ``checks`` and ``refinements``, in
    the order in which they came. A key has the rows of one page, so the list is short.
    """
    kept = F.struct(*fields)
    listed = F.array_sort(F.collect_list(F.struct(place, "gone", "skip", "match", "suggestion", kept.alias("row"))))
    kind = rows.select(kept.alias("row")).schema["row"].dataType
    empty = F.struct(F.lit(0).alias("checks"), F.lit(False).alias("over"), F.lit(None).cast(kind).alias("taken"), F.array().cast("array<string>").alias("refinements"))

    def look(s: Column, c: Column) -> Column:
        new = c["suggestion"].isNotNull() & ~F.array_contains(s["refinements"], c["suggestion"])
        noted = F.when(~c["match"] & F.coalesce(new, F.lit(False)), F.array_append(s["refinements"], c["suggestion"])).otherwise(s["refinements"])
        taken = F.when(c["match"], c["row"]).otherwise(s["taken"])
        checked = F.struct((s["checks"] + 1).alias("checks"), c["match"].alias("over"), taken.alias("taken"), noted.alias("refinements"))
        ended = F.struct(s["checks"].alias("checks"), F.lit(True).alias("over"), s["taken"].alias("taken"), s["refinements"].alias("refinements"))
        return F.when(s["over"] | c["gone"] | c["skip"], s).when(s["checks"] >= most, ended).otherwise(checked)

    out = rows.groupBy(*keys).agg(listed.alias("__listed")).withColumn("__end", F.aggregate("__listed", empty, look))
    return out.select(*keys, "__end.taken", "__end.checks", "__end.refinements")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__first = 1").drop("__first")


def serp_rank(rows: DataFrame, page: list[str], order: list[str], most: int = fixed.MAX_SERP_ROWS) -> DataFrame:
    """Accepted rows of a page, numbered as they come, as many as a page may give."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy(*order))).where(F.col("rank") <= most)
