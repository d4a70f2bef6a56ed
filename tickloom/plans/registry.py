"""Registry of named queries: a Spark callable and, where it exists, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: dict[str, int], keep: tuple[str, ...] = ("symbol", "bar_date")) -> DataFrame:
    """Key columns as they are, numbers rounded; adding 0.0 removes negative zeros."""
    return df.select(*keep, *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in digits.items()])


def rounded_sql(columns: dict[str, tuple[str, int]], source: str, keep: str = "symbol, bar_date", rest: str = "") -> str:
    body = ", ".join(f"round({e}, {d}) + 0.0 AS {name}" for name, (e, d) in columns.items())
    return f"SELECT {keep}, {body} FROM {source} {rest}"
