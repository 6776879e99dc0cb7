"""Sorted listings, top-k reports and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.shaping import date_range


def listing(df: DataFrame, time: str, filters: dict | None = None, start: str | None = None, end: str | None = None,
            limit: int = 100, ties: Sequence[str] = ()) -> DataFrame:
    """Newest rows of a table under equality filters and a time range."""
    for c, v in (filters or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    return date_range(df, time, start, end).orderBy(F.col(time).desc(), *[F.col(t).desc() for t in ties]).limit(limit)


def worst_predictions(df: DataFrame, n: int = 20, actual: str = "actual", predicted: str = "predicted", ties: Sequence[str] = ()) -> DataFrame:
    err = df.withColumn("error", F.col(actual) - F.col(predicted)).withColumn("abs_error", F.abs("error"))
    return err.orderBy(F.col("abs_error").desc(), *ties).limit(n)


def best_and_worst(df: DataFrame, key: str, score: str, n: int = 3) -> DataFrame:
    """First and last n keys by score (one row per key)."""
    best = df.orderBy(F.col(score).asc(), key).limit(n).withColumn("group", F.lit("best"))
    worst = df.orderBy(F.col(score).desc(), key).limit(n).withColumn("group", F.lit("worst"))
    return best.unionByName(worst)


def top_by_absolute(df: DataFrame, value: str, k: int, ties: Sequence[str] = ("variable",)) -> DataFrame:
    return df.orderBy(F.abs(value).desc(), *ties).limit(k)


def recent(df: DataFrame, time: str, minutes: int, as_of: datetime, operation: str | None = None, errors_only: bool = False,
           op_col: str = "operation", error_col: str = "is_error") -> DataFrame:
    """Rows of the last minutes before `as_of`, by operation, errors only if asked."""
    out = df.where(F.col(time) > F.lit((as_of - timedelta(minutes=minutes)).isoformat(sep=" ")).cast("timestamp"))
    if operation is not None:
        out = out.where(F.col(op_col) == operation)
    return out.where(F.col(error_col)) if errors_only else out


def leaderboard(df: DataFrame, metric: str, value: str, model: str) -> DataFrame:
    """Rank of every model per metric, R² descending and errors ascending."""
    signed = F.when(F.col(metric) == "r2", -F.col(value)).otherwise(F.col(value))
    # one row per model and metric
    return df.withColumn("rank", F.rank().over(Window.partitionBy(metric).orderBy(signed, model)).cast("bigint"))


def stack(*frames: DataFrame) -> DataFrame:
    """Union all by name; columns missing on one side are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def category_changes(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, change) with change `new` or `missing` against the reference."""
    def long(df):
        return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value").where(
            F.col("value").isNotNull()).distinct()

    r, c = long(reference), long(current)
    return c.exceptAll(r).withColumn("change", F.lit("new")).unionByName(r.exceptAll(c).withColumn("change", F.lit("missing")))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))
