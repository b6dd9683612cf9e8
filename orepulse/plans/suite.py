"""Registry of runnable queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def half_up(expression: str, digits: int = 3) -> str:
    """SQL rounding by decimal digits, halves away from zero, as Spark rounds doubles."""
    return f"CAST(ROUND(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,15)), {digits}) AS DOUBLE)"


class Suite:
    """Named queries over the parquet tables; ``sql`` is the same result in ANSI SQL, where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query '{name}' is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.oracles[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def wrap(query: Query) -> Query:
            self.add(name, query, sql)
            return query

        return wrap
