"""All queries of the engine's own operators and their DuckDB equivalents, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import jobs, pages, predicates, relational, scalars, streams  # noqa: F401
from .queries.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["CA-04_comparison"](spark, sf_dir)
