"""Every query of the library by name, with equivalent SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from quireflow.plans import classify, layout, reports  # noqa: E402, F401  they register their queries
