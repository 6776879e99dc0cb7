"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import present, settle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under `key`; `sql` is its counterpart, absent where SQL cannot say it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, root: str) -> DataFrame:
            return present(fn(settle(spark), root), digits)

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register
