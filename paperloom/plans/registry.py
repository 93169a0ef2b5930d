"""All queries by name, and the SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans import filter_queries, table_queries, times

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"p1_found": times.found, "p1_coverage": times.coverage} | filter_queries.QUERIES | table_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return filter_queries.SQL | table_queries.SQL
