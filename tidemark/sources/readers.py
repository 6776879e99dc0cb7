"""Sources: CSV, JSON lines, JSON documents, store tables, dated result folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.shaping import date_range, parse_pair
from tidemark.session import nan_to_null

# Columns of the CSV sources; further columns of a file are not read.
OBSERVATION_CSV = "event_id bigint, location_id string, timestamp string, date string, occupancy double, capacity bigint"
WEATHER_CSV = "timestamp string, date string, temperature double, humidity double, wind_speed double, precipitation double"


def read_csv(spark: SparkSession, path: str, schema: str = OBSERVATION_CSV, start: str | None = None, end: str | None = None) -> DataFrame:
    """CSV with header; the time is `timestamp`, or `date` where that is missing; optional inclusive range."""
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    at = F.coalesce(F.try_to_timestamp("timestamp"), F.try_to_timestamp("date"))
    return date_range(nan_to_null(raw.withColumn("timestamp", at).drop("date")), "timestamp", start, end)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


METRIC_HISTORY = "history array<struct<timestamp: string, metrics: map<string, double>>>"
PROFILE = ("mean map<string, double>, std map<string, double>, quantiles map<string, map<string, double>>, "
           "categorical_stats map<string, map<string, double>>, timestamp string")


def read_metric_history(spark: SparkSession, path: str) -> DataFrame:
    """Documents holding a list of runs to one row per run and metric."""
    docs = spark.read.schema(METRIC_HISTORY).option("multiLine", True).json(path)
    runs = docs.select(F.explode("history").alias("r")).select(F.try_to_timestamp("r.timestamp").alias("timestamp"), F.explode("r.metrics").alias("metric_name", "value"))
    return runs


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Nested baseline documents to one row per feature: mean, std, quartiles."""
    d = spark.read.schema(PROFILE).option("multiLine", True).json(path)
    f = d.select(F.explode("mean").alias("feature", "mean"), "std", "quantiles")
    q = F.col("quantiles")
    return f.select("feature", "mean", F.try_element_at("std", F.col("feature")).alias("std"), *[
        F.try_element_at(F.try_element_at(q, F.lit(k)), F.col("feature")).alias(n) for k, n in (("0.25", "q25"), ("0.5", "q50"), ("0.75", "q75"))])


FACILITY_DOCUMENT = ("result struct<records: array<struct<Coordenades: string, places: string, tipus_estacionament: string, nom: string>>>")


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    """Saved open-data documents to facility rows; rows without coordinates are dropped."""
    docs = spark.read.schema(FACILITY_DOCUMENT).option("multiLine", True).json(path)
    r = docs.select(F.explode("result.records").alias("r")).select("r.*")
    lon, lat = parse_pair(F.col("Coordenades"))
    out = r.select(lat.alias("latitude"), lon.alias("longitude"), F.coalesce("tipus_estacionament", F.lit("Unknown")).alias("parking_type"),
                   F.coalesce(F.col("places").try_cast("double"), F.lit(0.0)).alias("capacity"), F.coalesce("nom", F.lit("Unknown")).alias("name"))
    return out.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def read_store(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None, equals: dict | None = None,
               time: str = "timestamp", start: str | None = None, end: str | None = None) -> DataFrame:
    """A store table (parquet folder or JDBC source) under equality and time filters, which Spark pushes
    into the source."""
    df = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)
    for c, v in (equals or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    return date_range(df, time, start, end)


def read_dated_results(spark: SparkSession, path: str, schema: str, as_of: str, days: int, feature: str | None = None,
                       pattern: str = r"drift_result_(\d{8}_\d{6})") -> DataFrame:
    """Result files whose name carries a time within the last days, newest first; files outside are not opened."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    at = F.try_to_timestamp(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit("yyyyMMdd_HHmmss"))
    out = df.withColumn("result_time", at).where(F.col("result_time") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))
    if feature is not None:
        out = out.where(F.col("feature") == feature)
    return out.orderBy(F.col("result_time").desc(), "feature")


def required_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df
