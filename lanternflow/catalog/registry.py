"""Query registry: a Spark callable and, where SQL can say the same, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def r6(c):
    """Round to six places for comparison across engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def micros(c: str = "timestamp"):
    return F.unix_micros(F.col(c))
