"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configured

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SALT = "pepper"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return configured(spark).createDataFrame(rows, schema)


def q(value) -> str:
    """A SQL literal."""
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def rows_sql(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)
