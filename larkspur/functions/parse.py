"""Prices, ratings and counts: parsing, comparing and showing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import C, col

PRICE = "decimal(38,10)"


def _decimal(text: Column) -> Column:
    return text.try_cast(PRICE)


def price(text: C) -> Column:
    """Positive price, or null."""
    value = _decimal(F.regexp_replace(col(text), "[^0-9.]", ""))
    return F.when(value > 0, value)


def rating(text: C) -> Column:
    """First number, a tenth of it where it is in (5, 50], if it is in [0, 5]."""
    value = F.regexp_extract(F.replace(col(text), F.lit(","), F.lit(".")), "([0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")
    value = F.when((value > 5) & (value <= 50), value / 10).otherwise(value)
    return F.when((value >= 0) & (value <= 5), value)


def review_count(text: C) -> Column:
    """First run of digits and commas as a number, or null."""
    return F.replace(F.regexp_extract(F.lower(col(text)), "([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("bigint")


def shown_number(text: C, kind: str) -> Column:
    """A displayed value again as a number; N/A and the like give null."""
    return F.replace(F.trim(col(text)), F.lit(","), F.lit("")).try_cast(kind)


def coerced_price(value: C) -> Column:
    """A JSON price (number or text, as text) as a positive price, or null."""
    number = _decimal(F.trim(col(value)))
    return F.when(number.isNotNull(), F.when(number > 0, number)).otherwise(price(value))


def gap(found: C, reference: C) -> Column:
    """Relative distance of a price from its reference, in double precision; 0 for a reference that is not positive."""
    f, r = col(found), col(reference)
    return F.when(r <= 0, F.lit(0.0)).otherwise(F.abs((f - r).cast("double")) / F.when(r > 0, r).cast("double"))


@F.pandas_udf(StringType())
def _one_decimal(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"{v:.1f}")


def shown_price(p: C) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(col(p), 2)), F.lit("N/A"))


def shown_rating(r: C) -> Column:
    """One decimal, halves as binary floats round (so 4.25 shows as 4.2)."""
    return F.coalesce(_one_decimal(col(r)), F.lit("N/A"))


def shown_count(n: C) -> Column:
    return F.coalesce(F.format_number(col(n), 0), F.lit("N/A"))


def method_label(method: C) -> Column:
    """How the method of an extraction is shown."""
    m = col(method)
    return F.when(m.isNull() | (m == "") | (m == "N/A"), "N/A").otherwise(F.lower(m))


def stars(r: C) -> Column:
    """Five stars, as many full ones as the rounded rating."""
    n = F.round(col(r)).cast("int")
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), F.lit(5) - n))


def ui_number(value: C) -> Column:
    return F.regexp_replace(F.nullif(col(value), F.lit("N/A")), "[$,]", "").try_cast("double")


def reject_reason(title: C, p: C, r: C, n: C, require_price: bool = True) -> Column:
    """Why extracted fields are not valid, the first reason; null where they are."""
    from .fixed import GENERIC_TITLES

    t, p, r, n = F.trim(col(title)), col(p), col(r), col(n)
    checks = [F.when(t.isNull() | (F.length(t) < 3), "missing or too-short title"), F.when(F.lower(t).isin(GENERIC_TITLES), "generic page title")]
    if require_price:
        checks += [F.when(p.isNull(), "missing price"), F.when(p <= 0, "nonsensical price")]
    return F.coalesce(*checks, F.when((r < 0) | (r > 5), "rating out of range"), F.when(n < 0, "negative review count"))
