"""Shared inputs of queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator's id, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a DuckDB table expression with the given column names."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns}))"


def expect(rows: list[tuple], columns: str) -> str:
    """SQL for the rows that a query on fixed input has to give."""
    return f"SELECT * FROM {values(rows, columns)}"


def array(strings: list[str]) -> str:
    return "[" + ", ".join(map(literal, strings)) + "]"


# Pairs of a query and a listing: examples of every filter, and all neighbouring parts.

PAIRS = [
    ("apple ipad", "Case for Apple iPad", ""),
    ("apple ipad", "Apple iPad 256GB", ""),
    ("bose headphones", "Bose Ultra Earbuds", ""),
    ("bose earbuds", "Bose Over-Ear", ""),
    ("bose headphones", "Bose over-ear headphones and in-ear case", "https://www.amazon.com/x/dp/B0D6WCQWJS"),
    ("bose headphones", "Bose QC Ultra", "https://www.amazon.com/dp/b0d6wcqwjs?x=1"),
    ("lg 65 inch tv", "LG 65 inch TV with soundbar", ""),
    ("lg tv soundbar", "LG TV soundbar bundle", ""),
    ("lg 65 inch tv", "LG 65 inch TV", "https://www.walmart.com/ip/lg-tv-wireless-speaker/731473988"),
    ("lenovo tab p12", "Lenovo Tab Plus", ""),
    ("lenovo tab p12 2024", "Lenovo Tab P12 (2023)", ""),
    ("lenovo tab p12 2024", "Lenovo Tab P12", ""),
    ("lenovo tab p12 2024", "Lenovo Tab P12-2024 128GB", ""),
    ("macbook pro m5", "Apple MacBook Pro M1", ""),
    ("macbook pro m5", "M1-M5 sleeve for MacBook", ""),
    ("macbook pro m1", "Apple MacBook Pro M5", ""),
    ("apple macbook air 13 inch", "MacBook Air charger 67W power adapter", ""),
    ("apple macbook air", "Apple MacBook Air 13 inch 256 gb SSD with charger", ""),
    ("laptop", "USB C hub docking station", ""),
    ("apple macbook pro", "Dell XPS 13 laptop", ""),
    ("tablet", "Replacement earpads for headphones", ""),
    ("monitor", "Keyboard case combo 2-pack", ""),
    ("oled 65 inch", "LG OLED 48 inch", ""),
    ("oled 65 inch", "LG OLED C4", ""),
    ("lg oled65c4pua", "LG 65 class OLED65C4PUA evo", ""),
    ("bose quietcomfort 45", "Bose QuietComfort Ultra", ""),
    ("bose quietcomfort 45", "Bose QuietComfort headphones", ""),
    ("bose quietcomfort 45", "Bose QuietComfort 35 II", ""),
    ("sony headphones", "Sony (Renewed) headphones", ""),
    ("used sony headphones", "Sony headphones open-box", ""),
    ("sony wh-1000xm5", "Sony WH-1000XM5 Wireless", ""),
    ("café machine 14\"", "Café Déjà 14-inch M5 (2024) 256GB", ""),
    ("gaming laptop 512 gb", "Refurbished gaming laptop 512 gb gen 3", ""),
    ("macbook", "Laptop cover compatible with MacBook", ""),
]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, query, title, url``: the examples, and each part against the next one."""
    rows = spark.createDataFrame([(-1 - i, *p) for i, p in enumerate(PAIRS)], "pair_id bigint, query string, title string, url string")
    part = table(spark, sf_dir, "part")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("title"))
    parts = part.join(following, "p_partkey").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("query"), "title", F.lit("").alias("url"))
    return rows.unionByName(parts)


def formed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_forms(pairs(spark, sf_dir), "query", "title")


def duck_norm(x: str) -> str:
    for pattern, new in ((r"[^\p{L}\p{N}_.\-]", " "), (r"\bgb\b", "gigabyte"), (r"\btb\b", "terabyte"), (r"\bgen\s*(\d+)\b", r"generation \1"), (r"\b(\d{1,2})\s*inch\b", r"\1 inch"), (r"\s+", " ")):
        x = f"regexp_replace({x if pattern[0] != '[' else f'lower(strip_accents({x}))'}, '{pattern}', '{new}', 'g')"
    return f"trim({x})"


def duck_models(n: str) -> str:
    return rf"list_filter(regexp_extract_all({n}, '\b([a-z]{{1,3}}[0-9]{{2,5}}|[0-9]{{4}}|[a-z]+[0-9]+[a-z]*[0-9]*|m[1-9])\b', 1), lambda x, i: list_position(regexp_extract_all({n}, '\b([a-z]{{1,3}}[0-9]{{2,5}}|[0-9]{{4}}|[a-z]+[0-9]+[a-z]*[0-9]*|m[1-9])\b', 1), x) = i)"


def duck_years(n: str) -> str:
    return rf"regexp_extract_all({n}, '\b((?:19|20)[0-9]{{2}})\b', 1)"


def duck_any(text: str, strings: list[str]) -> str:
    return f"(len(list_filter({array(strings)}, lambda p: contains({text}, p))) > 0)"


#: pairs and their normal forms: q, t (normalised), qm, tm (model tokens), qy, ty (years)
DUCK_PAIRS = f"""
pairs AS (
    SELECT CAST(pair_id AS BIGINT) AS pair_id, query, title, url FROM {values([(-1 - i, *p) for i, p in enumerate(PAIRS)], "pair_id, query, title, url")}
    UNION ALL
    SELECT a.p_partkey, a.p_name, b.p_name, '' FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
normed AS (SELECT *, {duck_norm("query")} AS q, {duck_norm("title")} AS t FROM pairs),
p AS (SELECT *, {duck_models("q")} AS qm, {duck_models("t")} AS tm, {duck_years("q")} AS qy, {duck_years("t")} AS ty,
    left(split_part(t, 'compatible with', 1), 140) AS head FROM normed)
"""


def on_pairs(select: str) -> str:
    return f"WITH {DUCK_PAIRS} SELECT pair_id, {select} FROM p"
