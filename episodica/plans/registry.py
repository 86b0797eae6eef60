"""Named queries over the test tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def rounded(digits: int = 6, **columns: str | Column) -> list[Column]:
    return [F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name) for name, c in columns.items()]


def r(*names: str, digits: int = 6) -> list[Column]:
    """Columns rounded for comparison, names kept."""
    return [F.round(F.col(n), digits).alias(n) for n in names]
