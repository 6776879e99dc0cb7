"""Table maintenance as frames: updates, deletes, retention, copies. sources.tables applies them to stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def newest(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One change per key: the one with the largest `order`; without it, or in a tie, the largest row."""
    rest = [c for c in changes.columns if c != key]
    rank = F.struct(*([F.col(order).alias("__order")] if order else []), *rest)
    return changes.groupBy(key).agg(F.max(rank).alias("__c")).select(key, *[F.col(f"__c.{c}").alias(c) for c in rest]).select(*changes.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of `changes` replace or extend the rows with the same key; of several changes of a key the one with the
    largest `order` counts, without it the largest row."""
    changes = newest(changes, key, order)
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def update_by_id(table: DataFrame, changes: DataFrame, key: str, order: str | None = None, clear: str | None = None) -> DataFrame:
    """Set the non-null columns of `changes` on the rows with the same key; other rows stay.

    Of several changes of a key the one with the largest `order` counts. `clear` names an array column of `changes` with the
    names of columns to set to null."""
    cols = [c for c in changes.columns if c in table.columns and c != key]
    c = newest(changes, key, order).select(key, *[F.col(x).alias(f"__{x}") for x in cols], *([F.col(clear).alias("__clear")] if clear else []))
    j = table.join(c, key, "left")
    emptied = lambda x: F.coalesce(F.array_contains("__clear", x), F.lit(False)) if clear else F.lit(False)
    return j.select(*[F.when(~emptied(x), F.coalesce(F.col(f"__{x}"), F.col(x))).alias(x) if x in cols else F.col(x) for x in table.columns])


def delete_by_id(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def retain(table: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than the retention period."""
    return table.where(F.col(time) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))


def retention_report(table: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Kept and deleted row counts."""
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    return table.agg(F.count_if(F.col(time) >= cut).alias("kept"), F.count_if(F.col(time) < cut).alias("deleted"))


def copy_with_view(df: DataFrame, path: str, view: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Write a copy and publish it under a view with the old column names."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path).withColumnsRenamed(rename or {})
    out.createOrReplaceTempView(view)
    return out
