"""Titles as columns: normalisation and what is read from normalised text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)), na_action="ignore")


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def has_any(text: Column, values: list[str]) -> Column:
    """Whether the text has one of the phrases."""
    return F.exists(words(values), lambda p: F.contains(text, p))


def has_new(title: Column, query: Column, values: list[str]) -> Column:
    """The phrases that the title has and the query does not."""
    return F.filter(words(values), lambda p: F.contains(title, p) & ~F.contains(query, p))


def normalized(text: C) -> Column:
    """Lower-case text without accents or symbols; only texts beyond ASCII visit Python."""
    text = col(text)
    beyond = text.rlike(r"[^\x00-\x7F]")
    out = F.lower(F.when(beyond, _without_marks(F.when(beyond, text))).otherwise(text))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_.-]", " ")
    for pattern, new in fixed.ALIASES:
        out = F.regexp_replace(out, f"(?iU){pattern}", new)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def tokens(norm: C) -> Column:
    return F.filter(F.split(col(norm), " "), lambda t: (t != "") & ~t.isin(fixed.STOPWORDS))


def model_tokens(norm: C) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(norm), F.lit(f"(?iU){fixed.MODEL_TOKEN}"), 1))


def years(norm: C) -> Column:
    return F.regexp_extract_all(col(norm), F.lit(f"(?U){fixed.YEAR}"), 1)


def inch_sizes(*blobs: C) -> Column:
    """Distinct two-digit screen sizes, ascending."""
    out = F.array().cast("array<int>")
    for blob in blobs:
        for pattern in (r"\b([0-9]{2})\s*-?\s*inch\b", r"\b([0-9]{2})\s*class\b", "oled([0-9]{2})"):
            found = F.regexp_extract_all(F.coalesce(col(blob), F.lit("")), F.lit(f"(?i){pattern}"), 1)
            out = F.array_union(out, F.transform(found, lambda x: x.cast("int")))
    return F.array_sort(out)


def series_numbers(norm: C) -> Column:
    return F.regexp_extract_all(col(norm), F.lit("(?<![a-z0-9])([0-9]{2,3})(?![a-z0-9])"), 1)


def model_codes(model: C) -> Column:
    """Model tokens with letters and digits, chips like m1 apart."""
    return F.filter(col(model), lambda t: (F.length(t) >= 2) & t.rlike("[0-9]") & t.rlike(r"\p{L}") & ~t.rlike("(?i)^m[1-9]$"))


def chips(norm: C) -> Column:
    return F.transform(F.regexp_extract_all(col(norm), F.lit(r"(?iU)\bm([1-9])\b"), 1), lambda x: x.cast("int"))


def overlap(a: C, b: C) -> Column:
    """Whether two lists share an entry."""
    return F.arrays_overlap(col(a), col(b))


def common(a: C, b: C) -> Column:
    """How many distinct entries two lists share."""
    return F.size(F.array_intersect(col(a), col(b)))


def recall(query_tokens: C, title_tokens: C) -> Column:
    q, t = F.transform(col(query_tokens), F.lower), F.transform(col(title_tokens), F.lower)
    hits = F.size(F.filter(q, lambda x: F.array_contains(t, x)))
    return F.when(F.size(q) == 0, 1.0).otherwise(hits / F.greatest(F.size(q), F.lit(1)))


def bundle_penalty(query: C, title: C) -> Column:
    q, t = col(query), col(title)
    return F.size(has_new(t, q, fixed.BUNDLE_WORDS)) * 8.0 + F.size(has_new(t, q, fixed.BUNDLE_MARKERS)) * 12.0


def asks_for_used(query: C) -> Column:
    return F.coalesce(col(query), F.lit("")).rlike(f"(?iU){fixed.USED_QUERY}")


def is_non_new(title: C) -> Column:
    return F.coalesce(col(title), F.lit("")).rlike(f"(?iU){fixed.NON_NEW}")


def condition_penalty(query: C, title: C) -> Column:
    return F.when(~asks_for_used(query) & is_non_new(title), 22.0).otherwise(0.0)


def normal_form(text: C) -> Column:
    """All of it as a struct: raw, normalized, tokens, model_tokens, years."""
    n = normalized(text)
    return F.struct(col(text).alias("raw"), n.alias("normalized"), tokens(n).alias("tokens"), model_tokens(n).alias("model_tokens"), years(n).alias("years"))


def collapsed(text: C) -> Column:
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def shortened(text: C, limit: int = 160) -> Column:
    t = collapsed(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def truncated(text: C, most: int = 60) -> Column:
    t = F.trim(F.replace(col(text), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))


def log_slug(text: C) -> Column:
    s = F.lower(F.trim(F.regexp_replace(col(text), r"(?U)[^\w\s-]", "")))
    s = F.regexp_replace(F.substring(F.regexp_replace(s, r"(?U)[\s_]+", "-"), 1, 48), "^-+|-+$", "")
    return F.when(s == "", "query").otherwise(s)


def site_slug(name: C) -> Column:
    s = F.regexp_replace(F.translate(F.lower(col(name)), " .", "_"), "[^a-z0-9_]+", "")
    return F.when(s == "", "site").otherwise(s)


def key(text: C) -> Column:
    return F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]", "")


def is_junk_title(title: C) -> Column:
    """Rows of search pages that name no product."""
    t = collapsed(title)
    glitch = t.rlike(r"(?i)(ILS|USD|EUR)\s*[0-9,.]+") & ~t.rlike("(?i)[a-z]{4,}")
    twice = (F.size(F.split(t, "ILS")) >= 3) & ~t.rlike("(?i)headphone|bose")
    price_only = t.rlike(r"(?i)^\s*((ILS|USD|EUR|GBP|CAD|\$|€|£)\s*[0-9,.\s]+|([0-9,]+\.?[0-9]*)\s*(ILS|USD|EUR|GBP|CAD))\s*$")
    chrome = t.rlike(r"(?i)^\s*(see\s+options?|see\s+all\s+|shop\s+now|more\s+results|sponsored)\s*$")
    return (F.length(t) < 12) | chrome | price_only | glitch | t.rlike(r"(?i)\btypical:\s*(ILS|USD)") | twice
