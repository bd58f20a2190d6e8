"""Judgements as tables: what a checker said, joined on, with its defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import C, col

#: What a checker may ask for where titles do not match.
ACTIONS = ["try_next_candidate", "refine_search", "reject_junk"]


def truthy(value: C) -> Column:
    """A JSON boolean given as text."""
    return F.coalesce(F.lower(F.trim(col(value))).isin("true", "yes", "1"), F.lit(False))


def action(raw: C, match: C) -> Column:
    a = F.replace(F.lower(F.trim(F.coalesce(col(raw), F.lit("")))), F.lit("-"), F.lit("_"))
    return F.when(col(match), "accept").when(a.isin(ACTIONS), a).otherwise("try_next_candidate")


def suggested(act: C, suggestion: C, expected: C) -> Column:
    s = F.nullif(F.trim(F.coalesce(col(suggestion), F.lit(""))), F.lit(""))
    return F.when((col(act) == "refine_search") & s.isNull(), col(expected)).otherwise(s)


def titles(rows: DataFrame, verdicts: DataFrame, enabled: bool = True) -> DataFrame:
    """``expected, scraped`` with ``match`` and ``verified``: without a verdict a title is accepted unverified.

    Where verdicts have an ``action`` and a ``suggested_search``, rows have a ``suggestion`` too.
    """
    says = "action" in verdicts.columns
    more = [F.col("action").alias("__action"), F.col("suggested_search").alias("__suggested")] if says else []
    joined = rows.join(verdicts.select("expected", "scraped", F.col("match").alias("__match"), *more), ["expected", "scraped"], "left")
    e, s = F.trim(F.coalesce("expected", F.lit(""))), F.trim(F.coalesce("scraped", F.lit("")))
    checked = F.lit(enabled) & (e != "") & (s != "")
    same = F.lower(e) == F.lower(s)
    match = F.when(~checked | same, True).otherwise(F.coalesce("__match", F.lit(True)))
    out = [match.alias("match"), (checked & (same | F.col("__match").isNotNull())).alias("verified")]
    if says:
        out.append(F.when(~match, suggested(action("__action", match), "__suggested", "expected")).alias("suggestion"))
    return joined.select(*rows.columns, *out)


def prices(rows: DataFrame, verdicts: DataFrame, enabled: bool = True) -> DataFrame:
    """``website, title, price`` with ``plausible`` and ``verified``; a price that is not positive is refused."""
    keys = ["website", "title", "price"]
    joined = rows.join(verdicts.select(*keys, F.col("plausible").alias("__plausible")), keys, "left")
    bad = F.coalesce(F.col("price") <= 0, F.lit(False))
    plausible = F.when(F.lit(not enabled), True).when(bad, False).otherwise(F.coalesce("__plausible", F.lit(True)))
    return joined.select(*rows.columns, plausible.alias("plausible"), (F.lit(enabled) & (bad | F.col("__plausible").isNotNull())).alias("verified"))


def trust(rating: C, count: C) -> Column:
    r, n = col(rating), col(count)
    return F.when(r.isNull() | n.isNull(), "Unknown").when((r >= 4.8) & (n >= 10_000), "Low").otherwise("Medium")


def trust_reason(rating: C, count: C) -> Column:
    reasons = {"Low": "Suspiciously perfect rating on a high-volume product.", "Medium": "Rating pattern looks normal."}
    label = trust(rating, count)
    return F.when(label == "Low", reasons["Low"]).when(label == "Medium", reasons["Medium"]).otherwise("")


def trusted(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows with the label that was given, if it is one, else the rule's."""
    keys = ["website", "title"]
    given = verdicts.where(F.col("trust_label").isin("High", "Medium", "Low")).select(*keys, F.col("trust_label").alias("__label"))
    joined = rows.join(given, keys, "left")
    known = F.col("average_rating").isNotNull()
    label = F.when(~known, "Unknown").otherwise(F.coalesce("__label", trust("average_rating", "review_count")))
    return joined.select(*rows.columns, label.alias("trust_label"))


def components(spark) -> DataFrame:
    return spark.createDataFrame(fixed.COMPONENTS, "component_order int, component string, consequence string")


def degradations(log: DataFrame) -> DataFrame:
    """The first cause of each component, in pipeline order and then by name."""
    first = log.groupBy("component").agg(F.min_by("cause", "seq").alias("cause"))
    named = first.join(F.broadcast(components(log.sparkSession)), "component", "left")
    return named.select("component", "cause", F.coalesce("consequence", F.lit(fixed.OTHER_CONSEQUENCE)).alias("consequence"), F.coalesce("component_order", F.lit(len(fixed.COMPONENTS))).alias("component_order")).orderBy("component_order", "component")
