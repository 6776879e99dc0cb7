"""Logical tables over the given parquet tables, in Spark and as SQL common table expressions.

Every definition is arithmetic on existing columns, so both sides describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import read_table

SPLIT_DAY = "2024-01-16"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def obs(spark: SparkSession, root: str) -> DataFrame:
    """Observations: irregular readings of 20 locations."""
    loc = F.col("user_id") % 20
    kind = F.col("user_id") % 3
    return read_table(spark, root, "events").select(
        "event_id",
        F.concat(F.lit("LOC_"), loc.cast("string")).alias("location_id"),
        F.col("ts").alias("timestamp"),
        F.least(F.col("value"), F.lit(100.0)).alias("occupancy"),
        F.when(kind == 0, "Public").when(kind == 1, "Resident").otherwise("Mixed").alias("parking_type"),
        (50 + 20 * loc).alias("capacity"),
        (F.lit(41.36) + loc * 0.004).alias("latitude"),
        (F.lit(2.12) + loc * 0.006).alias("longitude"),
        _k().alias("k"),
        F.col("value").alias("raw_value"),
    )


def obs_hourly(spark: SparkSession, root: str) -> DataFrame:
    """Mean occupancy per location and hour; hours without a reading are absent."""
    return (
        obs(spark, root)
        .groupBy("location_id", F.date_trunc("hour", "timestamp").alias("timestamp"))
        .agg(F.avg("occupancy").alias("occupancy"), F.max("capacity").alias("capacity"),
             F.max("parking_type").alias("parking_type"))
    )


def weather(spark: SparkSession, root: str) -> DataFrame:
    """Irregular weather readings."""
    return read_table(spark, root, "events").where(F.col("event_type") == "view").select(
        F.col("ts").alias("weather_time"),
        (F.col("value") / 5).alias("temperature"),
        _k().cast("double").alias("humidity"),
        (_k() % 30).cast("double").alias("wind_speed"),
        F.greatest(F.lit(0), _k() - 80).cast("double").alias("precipitation"),
    )


def obs_weather(spark: SparkSession, root: str) -> DataFrame:
    """Observations with weather columns of their own (for row-wise feature expressions)."""
    return obs(spark, root).withColumns(
        {
            "temperature": F.col("raw_value") / 5,
            "humidity": F.col("k").cast("double"),
            "wind_speed": (F.col("k") % 30).cast("double"),
            "precipitation": F.greatest(F.lit(0), F.col("k") - 80).cast("double"),
        }
    )


def city_events(spark: SparkSession, root: str) -> DataFrame:
    e = read_table(spark, root, "events").where(F.col("event_type") == "signup")
    site = F.col("event_id") % 20
    return e.select(
        "event_id",
        F.col("ts").alias("start_time"),
        (F.col("ts") + F.expr("interval 3 hours")).alias("end_time"),
        (_k() / 100.0).alias("impact_factor"),
        (F.lit(41.36) + site * 0.004).alias("event_lat"),
        (F.lit(2.12) + site * 0.006).alias("event_lon"),
    )


def facilities(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("facility_id"),
        F.col("s_name").alias("facility_name"),
        (F.lit(41.35) + (F.col("s_suppkey") * 37 % 1000) / 10000).alias("latitude"),
        (F.lit(2.10) + (F.col("s_suppkey") * 53 % 1300) / 10000).alias("longitude"),
        (50 + F.col("s_suppkey") % 450).alias("capacity"),
        F.when(F.col("s_suppkey") % 3 == 0, "Public").when(F.col("s_suppkey") % 3 == 1, "Resident")
        .otherwise("Mixed").alias("parking_type"),
    )


def points(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "customer").select(
        F.col("c_custkey").alias("point_id"),
        (F.lit(41.35) + (F.col("c_custkey") * 71 % 1000) / 10000).alias("latitude"),
        (F.lit(2.10) + (F.col("c_custkey") * 89 % 1300) / 10000).alias("longitude"),
    )


def raw_dirty(spark: SparkSession, root: str) -> DataFrame:
    """Raw records with nulls, impossible values and malformed text."""
    o = read_table(spark, root, "orders")
    key = F.col("o_orderkey")
    loc = F.concat(F.lit("LOC_"), (F.col("o_custkey") % 20).cast("string"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return o.select(
        key.alias("record_id"),
        F.when(key % 97 != 0, key % 101).alias("total_spots"),
        F.when(key % 103 != 0, F.col("o_custkey") % 120 - F.when(key % 107 == 0, 121).otherwise(0)).alias("available_spots"),
        F.when(key % 89 != 0, F.col("o_totalprice") / 400000).alias("occupancy_rate"),
        F.when(key % 71 == 0, "").when(key % 73 == 0, "LOC 1!").when(key % 79 != 0, loc).alias("location_id"),
        F.when(key % 83 == 0, "2023-02-31 10:00:00").when(key % 113 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(key % 109 != 0, stamp).alias("timestamp"),
        F.when(key % 61 == 0, "maybe").when(key % 59 != 0, F.when(key % 2 == 0, "true").otherwise("0")).alias("is_holiday"),
        F.when(key % 67 == 0, 9).when(key % 53 != 0, F.weekday("o_orderdate")).cast("bigint").alias("day_of_week"),
        F.when(key % 47 == 0, 24).when(key % 43 != 0, key % 24).cast("bigint").alias("hour_of_day"),
        F.when(key % 41 != 0, F.concat(F.lit("v1."), (F.col("o_custkey") % 3).cast("string"))).alias("model_version"),
    )


def dirty_predictions(spark: SparkSession, root: str) -> DataFrame:
    return raw_dirty(spark, root).select(
        "record_id",
        F.col("occupancy_rate").alias("predicted_occupancy"),
        "location_id",
        F.col("timestamp").alias("prediction_timestamp"),
        F.when(F.col("record_id") % 31 != 0, F.col("timestamp")).alias("predicted_for_timestamp"),
        F.when(F.col("record_id") % 37 == 0, " ").otherwise(F.col("model_version")).alias("model_version"),
    )


def predictions(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_quantity").alias("actual"),
        (F.col("l_quantity") * (1 + F.col("l_discount") - F.col("l_tax"))).alias("predicted"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("model_id"),
        F.concat(F.lit("LOC_"), (F.col("l_suppkey") % 20).cast("string")).alias("location_id"),
    )


def metrics(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_id"),
        F.col("event_type").alias("metric_name"),
        F.col("value"),
        F.col("ts").alias("timestamp"),
        "event_id",
    )


def scored_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Metric log with the metric names the threshold rules know."""
    n = F.col("user_id") % 4
    return read_table(spark, root, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_id"),
        F.when(n == 0, "rmse").when(n == 1, "mae").when(n == 2, "r2").otherwise("mape").alias("metric_name"),
        (F.col("value") / 100).alias("value"),
        F.col("ts").alias("timestamp"),
        "event_id",
    )


def features(spark: SparkSession, root: str) -> DataFrame:
    """Three numeric columns and one category for profile and drift operators."""
    return read_table(spark, root, "events").select(
        "event_id", F.col("ts").alias("timestamp"), F.col("value"), _k().cast("double").alias("k"),
        (F.col("value") * (1 + F.col("user_id") % 7) / 10).alias("load"), F.col("event_type").alias("category"),
        F.concat(F.lit("z"), (F.col("user_id") % 6).cast("string")).alias("zone"),
    )


def reference(spark: SparkSession, root: str) -> DataFrame:
    return features(spark, root).where(F.col("timestamp") < F.lit(SPLIT_DAY).cast("timestamp"))


def current(spark: SparkSession, root: str) -> DataFrame:
    return features(spark, root).where(F.col("timestamp") >= F.lit(SPLIT_DAY).cast("timestamp"))


def op_log(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "events").select(
        "event_id", F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"),
        (F.col("user_id") % 10 == 0).alias("is_error"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_id"),
    )


def health(spark: SparkSession, root: str) -> DataFrame:
    v = F.col("value")
    return read_table(spark, root, "events").select(
        "event_id", F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("component"),
        F.when(v < 60, "healthy").when(v < 120, "degraded").otherwise("critical").alias("status"),
        F.col("ts").alias("timestamp"), v.alias("latency_ms"),
        F.when(F.col("event_type") == "error", 0.05).otherwise(0.0).alias("error_rate"),
        (_k() * 12.0).alias("memory_mb"), _k().cast("double").alias("cpu_percent"),
    )


def segments(spark: SparkSession, root: str) -> DataFrame:
    """Street segments with an availability level 0-3 per reading."""
    return read_table(spark, root, "events").select(
        "event_id", (F.col("user_id") % 25).alias("segment_id"), F.col("ts").alias("timestamp"),
        F.least(F.floor(F.col("value") / 30), F.lit(3)).cast("bigint").alias("level"),
        F.when(F.col("user_id") % 2 == 0, "BLAVA").otherwise("VERDA").alias("kind"),
        F.concat(F.format_number(1 + (F.col("user_id") % 7) / 4.0, 2), F.lit(" E/h <= 2h")).alias("tariff"),
    )


TABLES = {
    f.__name__: f
    for f in (obs, obs_hourly, weather, obs_weather, city_events, facilities, points, raw_dirty, dirty_predictions,
              predictions, metrics, scored_metrics, features, reference, current, op_log, health, segments)
}

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

SQL = {
    "obs": f"""SELECT event_id, 'LOC_' || (user_id % 20) AS location_id, ts AS "timestamp",
        least(value, 100.0::DOUBLE) AS occupancy,
        CASE user_id % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Resident' ELSE 'Mixed' END AS parking_type,
        50 + 20 * (user_id % 20) AS capacity, 41.36::DOUBLE + (user_id % 20) * 0.004::DOUBLE AS latitude,
        2.12::DOUBLE + (user_id % 20) * 0.006::DOUBLE AS longitude, {K} AS k, value AS raw_value FROM events""",
    "obs_hourly": """SELECT location_id, date_trunc('hour', "timestamp") AS "timestamp", avg(occupancy) AS occupancy,
        max(capacity) AS capacity, max(parking_type) AS parking_type FROM obs GROUP BY 1, 2""",
    "weather": f"""SELECT ts AS weather_time, value / 5 AS temperature, CAST({K} AS DOUBLE) AS humidity,
        CAST({K} % 30 AS DOUBLE) AS wind_speed, CAST(greatest(0, {K} - 80) AS DOUBLE) AS precipitation
        FROM events WHERE event_type = 'view'""",
    "obs_weather": """SELECT *, raw_value / 5 AS temperature, CAST(k AS DOUBLE) AS humidity,
        CAST(k % 30 AS DOUBLE) AS wind_speed, CAST(greatest(0, k - 80) AS DOUBLE) AS precipitation FROM obs""",
    "city_events": f"""SELECT event_id, ts AS start_time, ts + INTERVAL 3 HOURS AS end_time,
        {K} / 100.0::DOUBLE AS impact_factor, 41.36::DOUBLE + (event_id % 20) * 0.004::DOUBLE AS event_lat,
        2.12::DOUBLE + (event_id % 20) * 0.006::DOUBLE AS event_lon
        FROM events WHERE event_type = 'signup'""",
    "facilities": """SELECT s_suppkey AS facility_id, s_name AS facility_name,
        41.35::DOUBLE + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 10000 AS latitude,
        2.10::DOUBLE + CAST(s_suppkey * 53 % 1300 AS DOUBLE) / 10000 AS longitude, 50 + s_suppkey % 450 AS capacity,
        CASE s_suppkey % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Resident' ELSE 'Mixed' END AS parking_type FROM supplier""",
    "points": """SELECT c_custkey AS point_id, 41.35::DOUBLE + CAST(c_custkey * 71 % 1000 AS DOUBLE) / 10000 AS latitude,
        2.10::DOUBLE + CAST(c_custkey * 89 % 1300 AS DOUBLE) / 10000 AS longitude FROM customer""",
    "raw_dirty": """SELECT o_orderkey AS record_id,
        CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey % 101 END AS total_spots,
        CASE WHEN o_orderkey % 103 <> 0 THEN o_custkey % 120 - CASE WHEN o_orderkey % 107 = 0 THEN 121 ELSE 0 END END
            AS available_spots,
        CASE WHEN o_orderkey % 89 <> 0 THEN o_totalprice / 400000 END AS occupancy_rate,
        CASE WHEN o_orderkey % 71 = 0 THEN '' WHEN o_orderkey % 73 = 0 THEN 'LOC 1!'
            WHEN o_orderkey % 79 <> 0 THEN 'LOC_' || (o_custkey % 20) END AS location_id,
        CASE WHEN o_orderkey % 83 = 0 THEN '2023-02-31 10:00:00'
            WHEN o_orderkey % 113 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN o_orderkey % 109 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS "timestamp",
        CASE WHEN o_orderkey % 61 = 0 THEN 'maybe'
            WHEN o_orderkey % 59 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '0' END END AS is_holiday,
        CAST(CASE WHEN o_orderkey % 67 = 0 THEN 9 WHEN o_orderkey % 53 <> 0 THEN isodow(o_orderdate) - 1 END AS BIGINT)
            AS day_of_week,
        CAST(CASE WHEN o_orderkey % 47 = 0 THEN 24 WHEN o_orderkey % 43 <> 0 THEN o_orderkey % 24 END AS BIGINT)
            AS hour_of_day,
        CASE WHEN o_orderkey % 41 <> 0 THEN 'v1.' || (o_custkey % 3) END AS model_version FROM orders""",
    "dirty_predictions": """SELECT record_id, occupancy_rate AS predicted_occupancy, location_id,
        "timestamp" AS prediction_timestamp,
        CASE WHEN record_id % 31 <> 0 THEN "timestamp" END AS predicted_for_timestamp,
        CASE WHEN record_id % 37 = 0 THEN ' ' ELSE model_version END AS model_version FROM raw_dirty""",
    "predictions": """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part_id,
        l_quantity AS actual, l_quantity * (1 + l_discount - l_tax) AS predicted, l_shipdate AS "timestamp",
        l_returnflag AS model_id, 'LOC_' || (l_suppkey % 20) AS location_id FROM lineitem""",
    "metrics": """SELECT 'm' || (user_id % 5) AS model_id, event_type AS metric_name, value, ts AS "timestamp", event_id
        FROM events""",
    "scored_metrics": """SELECT 'm' || (user_id % 5) AS model_id,
        CASE user_id % 4 WHEN 0 THEN 'rmse' WHEN 1 THEN 'mae' WHEN 2 THEN 'r2' ELSE 'mape' END AS metric_name,
        value / 100 AS value, ts AS "timestamp", event_id FROM events""",
    "features": f"""SELECT event_id, ts AS "timestamp", value, CAST({K} AS DOUBLE) AS k,
        value * (1 + user_id % 7) / 10 AS "load", event_type AS category, 'z' || (user_id % 6) AS zone FROM events""",
    "reference": f"""SELECT * FROM features WHERE "timestamp" < TIMESTAMP '{SPLIT_DAY} 00:00:00'""",
    "current": f"""SELECT * FROM features WHERE "timestamp" >= TIMESTAMP '{SPLIT_DAY} 00:00:00'""",
    "op_log": """SELECT event_id, event_type AS operation, value AS duration_ms, user_id % 10 = 0 AS is_error,
        ts AS "timestamp", 'm' || (user_id % 5) AS model_id FROM events""",
    "health": f"""SELECT event_id, 'c' || (user_id % 5) AS component,
        CASE WHEN value < 60 THEN 'healthy' WHEN value < 120 THEN 'degraded' ELSE 'critical' END AS status,
        ts AS "timestamp", value AS latency_ms, CASE WHEN event_type = 'error' THEN 0.05 ELSE 0.0 END::DOUBLE AS error_rate,
        {K} * 12.0::DOUBLE AS memory_mb, CAST({K} AS DOUBLE) AS cpu_percent FROM events""",
    "segments": """SELECT event_id, user_id % 25 AS segment_id, ts AS "timestamp",
        CAST(least(floor(value / 30), 3) AS BIGINT) AS level,
        CASE WHEN user_id % 2 = 0 THEN 'BLAVA' ELSE 'VERDA' END AS kind,
        printf('%.2f', 1 + (user_id % 7) / 4.0::DOUBLE) || ' E/h <= 2h' AS tariff FROM events""",
}

NEEDS = {
    "obs_hourly": ["obs"],
    "obs_weather": ["obs"],
    "dirty_predictions": ["raw_dirty"],
    "reference": ["features"],
    "current": ["features"],
}


def ctes(*names: str, extra: str = "") -> str:
    """`WITH` clause defining the named logical tables (and what they need), plus further entries."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    # names that are SQL words are quoted
    parts = [f'"{n}" AS ({SQL[n]})' for n in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"
