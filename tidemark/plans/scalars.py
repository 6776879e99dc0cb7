"""One-row statistics next to every row, without a join.

The statistics travel as a scalar subquery: exactly one row by construction, evaluated once, so
there is no cross join and nothing that grows with the data is sent to the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATS = "__stats"


def with_stats(df: DataFrame, name: str = STATS, source: DataFrame | None = None, **aggs: Column) -> DataFrame:
    """Attach a struct `name` of global aggregates of `source` (default: df itself)."""
    one = (df if source is None else source).agg(F.struct(*[c.alias(k) for k, c in aggs.items()]).alias("s"))
    return df.withColumn(name, one.scalar())


def with_row(df: DataFrame, one_row: DataFrame, name: str = STATS) -> DataFrame:
    """Attach the single row of `one_row` as a struct column."""
    return df.withColumn(name, one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar())
