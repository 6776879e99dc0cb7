"""Sinks. Every writer uses Spark's committers; a retried task does not add rows twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared folder."""
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


# Text form of instants, to the microsecond.
TIME_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", TIME_TEXT).csv(path)


def csv_to_json_lines(spark: SparkSession, source: str, path: str, schema: str) -> None:
    spark.read.schema(schema).option("header", True).csv(source).write.mode("overwrite").json(path)


def write_by_suffix(df: DataFrame, path: str) -> None:
    """Parquet for a path that ends in .parquet, CSV otherwise."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        write_csv(df, path)


def append_log(df: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    df.write.mode("append").option("timestampFormat", TIME_TEXT).json(path)


def retraining_events(df: DataFrame, as_of: str) -> DataFrame:
    """Event rows (model_id, timestamp, success, details as JSON)."""
    rest = [c for c in df.columns if c not in ("model_id", "success")]
    return df.select("model_id", F.lit(as_of).cast("timestamp").alias("timestamp"), "success", F.to_json(F.struct(*rest)).alias("details"))


def insert_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, writers: int = 16, **options: str) -> None:
    """Batched inserts over a bounded number of connections; a failed task is retried by Spark."""
    df.coalesce(writers).write.format("jdbc").mode("append").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).save()


def checksums(df: DataFrame, *keys: str) -> DataFrame:
    """Row count and order-free checksum per partition value."""
    cols = sorted(c for c in df.columns if c not in keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*cols)).alias("checksum"))


def backup(df: DataFrame, path: str, time: str = "timestamp") -> DataFrame:
    """Partitioned copy by date and hour, read back and verified: (date, hour, rows, verified)."""
    p = df.withColumn("date", F.to_date(time)).withColumn("hour", F.hour(time))
    # one shuffle that gathers each partition's rows, and splits a partition too big for one file
    p.hint("rebalance", "date", "hour").write.mode("overwrite").partitionBy("date", "hour").parquet(path)
    back = df.sparkSession.read.parquet(path)
    a = checksums(p, "date", "hour")
    b = checksums(back.select(*p.columns), "date", "hour").withColumnsRenamed({"rows": "rows_b", "checksum": "checksum_b"})
    j = a.join(b, ["date", "hour"], "full")
    ok = F.coalesce((F.col("rows") == F.col("rows_b")) & (F.col("checksum") == F.col("checksum_b")), F.lit(False))
    return j.select("date", "hour", "rows", ok.alias("verified"))


def export_validation(validated: DataFrame, path: str, key: str, n: int = 10) -> None:
    """Nested JSON: totals, counts per reason, first n bad rows (a report of fixed size)."""
    from tidemark.operators.quality import invalid_sample, validation_summary

    summary = validation_summary(validated).agg(F.map_from_entries(F.collect_list(F.struct("item", "amount"))).alias("summary"))
    bad = invalid_sample(validated, key, n)
    worst = bad.agg(F.sort_array(F.collect_list(F.struct(key, *[c for c in bad.columns if c != key]))).alias("invalid_records"))
    from tidemark.plans.scalars import with_row

    with_row(summary, worst, "w").select("summary", "w.invalid_records").write.mode("overwrite").json(path)
