"""Hard filters of a query against a listing, as boolean columns.

Queries and listings come as normal forms (``functions.text.normal_form``);
true means that the listing is no answer to the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from ..functions.text import C, col, has_any, has_new

_MACBOOK = r"^(refurbished\s+)?apple\s+macbook"
_DOCK = r"\b(usb c hub|docking station|hub adapter)\b"


def _n(form: Column) -> Column:
    return form["normalized"]


def _head(title: Column, most: int = 140) -> Column:
    return F.substring(F.split_part(title, F.lit("compatible with"), F.lit(1)), 1, most)


def peripheral(q: Column, t: Column) -> Column:
    """Chargers, adapters, hubs and docks for a query that asks for a device."""
    query, title = _n(q), _n(t)
    head = _head(title)
    configured = head.rlike(r"\b[0-9]{1,2}\s*inch\b") & head.rlike(r"\b([0-9]+\s*gb|[0-9]+\s*tb|ssd|m[1-9]\s+chip)\b")
    charger = head.rlike(r"\bmacbook\s+(air|pro)\s+charger\b")
    power = head.rlike(r"\b(charger|power adapter|charging adapter)\b")
    dock = head.rlike(_DOCK) & ~head.rlike(_MACBOOK)
    verdict = F.when(charger, True).when(power, ~configured).otherwise(dock)
    applies = has_any(query, fixed.DEVICE_WORDS) & has_any(head, fixed.PERIPHERAL_WORDS) & ~title.rlike(rf"{_MACBOOK}\s+(pro|air)\b")
    return applies & verdict


def accessory(q: Column, t: Column) -> Column:
    query, title = _n(q), _n(t)
    head = _head(title)
    covers = head.rlike(r"\b(case|cover|folio|shell|sleeve)\b") & ~head.rlike(rf"{_MACBOOK}\s+(pro|air)\b")
    docks = head.rlike(_DOCK) & ~head.rlike(_MACBOOK)
    for_device = has_any(query, fixed.DEVICE_WORDS) & ~F.contains(query, F.lit("case")) & (covers | docks)
    apple = query.rlike(r"\bapple\s+macbook\b") | (F.contains(query, F.lit("macbook")) & F.contains(query, F.lit("apple")))
    unbranded = apple & ~_head(title, 100).rlike(r"\b(apple|macbook)\b")
    phrase = F.size(has_new(title, query, fixed.ACCESSORY_PHRASES)) > 0
    keyboard_case = F.contains(title, F.lit("keyboard")) & F.contains(title, F.lit("case")) & ~F.contains(query, F.lit("keyboard")) & ~F.contains(query, F.lit("case"))
    return peripheral(q, t) | for_device | unbranded | phrase | keyboard_case


def _wants(q: Column, one: str, other: str) -> Column:
    return F.contains(_n(q), F.lit(one)) & ~F.contains(_n(q), F.lit(other))


def earbuds_vs_headphones(q: Column, t: Column) -> Column:
    buds, over = has_any(_n(t), fixed.EARBUD_WORDS), has_any(_n(t), fixed.OVER_EAR_WORDS)
    return (_wants(q, "headphone", "earbud") & buds & ~over) | (_wants(q, "earbud", "headphone") & over & ~buds)


def known_earbuds(q: Column, url: C) -> Column:
    return _wants(q, "headphone", "earbud") & F.coalesce(urls.asin(url).isin(fixed.EARBUD_ASINS), F.lit(False))


def bundle(q: Column, t: Column, url: C) -> Column:
    blob = F.concat_ws(" ", _n(t), F.lower(F.coalesce(col(url), F.lit(""))))
    return ~has_any(_n(q), fixed.BUNDLE_QUERY_WORDS) & has_any(blob, fixed.BUNDLE_MARKERS)


def model_code(q: Column, t: Column) -> Column:
    return F.exists(text.model_codes(q["model_tokens"]), lambda c: ~F.contains(_n(t), F.lower(c)))


def chip_generation(q: Column, t: Column) -> Column:
    wanted, has = F.array_max(text.chips(_n(q))), text.chips(_n(t))
    return F.coalesce((F.array_max(has) < wanted) | ((F.size(has) >= 2) & (F.array_min(has) < wanted)), F.lit(False))


def screen_size(q: Column, t: Column, url: C) -> Column:
    wanted, has = text.inch_sizes(_n(q), F.array_join(q["model_tokens"], " ")), text.inch_sizes(_n(t), url)
    return (F.size(wanted) > 0) & (F.size(has) > 0) & ~text.overlap(wanted, has)


def year(q: Column, t: Column) -> Column:
    wanted = F.get(q["years"], F.lit(0))
    return F.coalesce((F.size(t["years"]) > 0) & ~F.array_contains(t["years"], wanted), F.lit(False))


def numeric_series(q: Column, t: Column) -> Column:
    """A series number of the query is absent from a listing of its family that has another one or a variant's name."""
    wanted, has = text.series_numbers(_n(q)), text.series_numbers(_n(t))
    first = F.get(F.filter(F.split(_n(q), " "), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$")), F.lit(0))
    family = F.coalesce(F.array_contains(F.split(_n(t), " "), first), F.lit(False))
    return family & (F.size(F.array_except(wanted, has)) > 0) & ((F.size(has) > 0) | _n(t).rlike(f"(?i){fixed.VARIANT_WORD}"))


def model(q: Column, t: Column, url: C) -> Column:
    return model_code(q, t) | numeric_series(q, t) | chip_generation(q, t) | screen_size(q, t, url) | bundle(q, t, url)


def reason(q: Column, t: Column, url: C) -> Column:
    """The first filter that rejects a listing before it is scored, or null."""
    checks = {
        "accessory": accessory(q, t),
        "earbuds_vs_headphones": earbuds_vs_headphones(q, t),
        "bundle": bundle(q, t, url),
        "screen_size": screen_size(q, t, url),
        "model_code": model_code(q, t),
        "chip_generation": chip_generation(q, t),
        "year": year(q, t),
    }
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in checks.items()))


def skip_candidate(query: C, q: Column, title: C, t: Column, url: C) -> Column:
    """Used or bundled listings, unless the query asks for used ones."""
    return ~text.asks_for_used(query) & (text.is_non_new(title) | bundle(q, t, url))


def ram_kit(url_path: C, title: C) -> Column:
    """A memory kit's address under a laptop's heading."""
    p = F.replace(F.lower(col(url_path)), F.lit("\\"), F.lit("/"))
    t = F.lower(col(title))
    laptop = t.rlike("macbook (pro|air)") & t.rlike(r'\bm\s*[0-9]+|\b[0-9]+\s*-?\s*inch\b|[0-9]+"')
    return p.rlike("apple-mac(book|-mini)-memory") & laptop


def bot_page(html: C, website: C | None = None) -> Column:
    """Pages that block robots, by general patterns and the retailer's own."""
    low = F.lower(col(html))
    out = low.rlike("|".join(fixed.BOT_PATTERNS))
    if website is not None:
        for site, patterns in fixed.SITE_BOT_PATTERNS.items():
            out = out | ((col(website) == site) & low.rlike("|".join(patterns)))
    return F.coalesce(out, F.lit(False))


def add_on(identity: C) -> Column:
    """Add-on price rows, from the ids and classes around a price."""
    return has_any(F.lower(F.coalesce(col(identity), F.lit(""))), fixed.ADD_ON_WORDS)


def financing(raw: C) -> Column:
    t = F.lower(col(raw))
    squeezed = F.regexp_replace(t, "[  ]", "")
    return squeezed.rlike("/mo|/month|permonth|amonth") | (F.contains(t, F.lit("monthly")) & t.rlike("[0-9]"))


LAPTOP, LARGE_TV, INCHES = r"(?i)macbook\s+(pro|air)\b", r"(?i)(\boled\b|\bclass\s+oled\b|oled\s*evo)", r"(?i)\b[0-9]{2}\s*-?\s*inch\b"


def implausibly_low(title: C, p: C) -> Column:
    t, price = col(title), col(p)
    return (t.rlike(LAPTOP) & (price < 400)) | (t.rlike(LARGE_TV) & t.rlike(INCHES) & (price < 300))


def with_forms(df: DataFrame, *columns: str) -> DataFrame:
    """Add the normal form of each column as ``<column>_form``; each distinct text is normalised once."""
    for c in columns:
        forms = df.select(F.col(c).alias("__text")).where(F.col("__text").isNotNull()).distinct().withColumn(f"{c}_form", text.normal_form("__text"))
        df = df.join(forms, F.col(c) == F.col("__text"), "left").drop("__text")
    return df


def drop_accessories(listings: DataFrame, group: list[str]) -> DataFrame:
    """Listings without accessories; where a group has nothing else, none for a device query and all for others."""
    q, t = F.col("query_form"), F.col("title_form")
    keep = ~accessory(q, t)
    left = F.count_if(keep).over(Window.partitionBy(*group))
    return listings.withColumn("__keep", keep).withColumn("__left", left).where(F.col("__keep") | ((F.col("__left") == 0) & ~has_any(_n(q), fixed.DEVICE_WORDS))).drop("__keep", "__left")
