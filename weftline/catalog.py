"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
OPS: dict[str, tuple[str, ...]] = {}


def query(name: str, *ops: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``f(spark, sf_dir)`` as ``name``; ``ops`` are the catalogue rows it covers, ``sql`` its DuckDB twin."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        OPS[name] = ops
        if sql is not None:
            SQL[name] = sql
        return f

    return add
