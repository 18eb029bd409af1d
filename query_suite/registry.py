"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, except_for: Iterable[str] = ()) -> DataFrame:
    """Doubles rounded for comparison between engines, counts as BIGINT."""
    columns = []
    for name, dtype in df.dtypes:
        column = F.col(f"`{name}`")
        if dtype == "double" and name not in except_for:
            column = F.round(column, digits) + F.lit(0.0)
        elif dtype in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        columns.append(column.alias(name))
    return df.select(*columns)


def sql_rounded(columns: Iterable[str], digits: int = 6) -> str:
    """Comma-separated `round(expr, digits) AS name` for `name` or `expr AS name` items."""
    parts = []
    for column in columns:
        expr, _, name = column.rpartition(" AS ")
        parts.append(f"round({expr or name}, {digits}) + 0.0 AS \"{name}\"")
    return ", ".join(parts)
