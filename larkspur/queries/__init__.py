"""Queries by operator id, each over its whole input, with DuckDB equivalents where SQL can express them."""
