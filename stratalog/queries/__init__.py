"""The registered queries and their DuckDB statements, by theme."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, asked, checks, datalog, graphs, pieces, scans, structures


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return pieces.queries() | asked.queries() | checks.queries() | scans.queries() | datalog.queries() | analytics.queries() | graphs.queries() | structures.queries()


def oracle_sql() -> dict[str, str]:
    return pieces.oracle_sql() | asked.oracle_sql() | checks.oracle_sql() | datalog.oracle_sql() | analytics.oracle_sql() | graphs.oracle_sql() | structures.oracle_sql() | scans.oracle_sql()
