"""Registry of named queries over the test tables and their DuckDB twins.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame; the matching SQL
runs in DuckDB over the same tables (registered as views by name). Computed
columns carry the same names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name``; ``sql`` is its oracle (None: rows-only)."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
