"""Queries of the streaming family: the given tables arrive as files in time order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.operators.monitoring import alerts
from tidemark.registry.core import ORACLE, query
from tidemark.registry.features import SCORE_SQL, TS
from tidemark.registry.quality import PREDICTION, RAW, joined
from tidemark.sources.writers import scratch
from tidemark.streaming import jobs

CUTS = ["2024-01-08", "2024-01-16", "2024-01-24"]
FILES = 8


def as_files(df, name, time="timestamp"):
    """Write a table as consecutive time ranges of a fixed number of files; a trigger takes one range."""
    spark = df.sparkSession
    path = scratch(spark, name)
    at = F.col(time)
    for lo, hi in zip([None, *CUTS], [*CUTS, None]):
        part = df if lo is None else df.where(at >= F.lit(lo).cast("timestamp"))
        part = part if hi is None else part.where(at < F.lit(hi).cast("timestamp"))
        part.repartition(FILES).write.mode("append").parquet(path)
    return jobs.read_files(spark, path, df.schema, FILES)


def plain(df):
    """The rows as one stream of the written files."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return jobs.read_files(df.sparkSession, path, df.schema, 2)


@query("st1_extract_metrics", ctes("metrics") + f"""SELECT CASE WHEN event_id % 13 = 0 OR {TS} > TIMESTAMP '2024-01-25 00:00:00' THEN 'rejected' ELSE 'accepted' END AS outcome, event_id FROM metrics""")
def st1(spark, root):
    m = fx.metrics(spark, root).withColumn("model_id", F.when(F.col("event_id") % 13 != 0, F.col("model_id")))
    good, bad = scratch(spark, "good"), scratch(spark, "bad")
    jobs.extract_metrics(as_files(m, "metrics"), good, bad, "2024-01-25 00:00:00")
    a = spark.read.parquet(good).select(F.lit("accepted").alias("outcome"), "event_id")
    return a.unionByName(spark.read.parquet(bad).select(F.lit("rejected").alias("outcome"), "event_id"))


ST2 = "ch AS (SELECT *, " + "CASE " + " ".join(f"WHEN {TS} < TIMESTAMP '{hi} 00:00:00' THEN {i}" for i, hi in enumerate(CUTS)) + f""" ELSE 9 END AS b FROM metrics),
    g AS (SELECT metric_name, b, count(*) AS n, arg_max(value, {TS}) AS last_value, max(epoch_us({TS})) AS last_us FROM ch GROUP BY 1, 2)"""


@query("st2_running_metrics", ctes("metrics", extra=ST2) + """SELECT metric_name, CAST(sum(n) OVER w AS BIGINT) AS count, last_value, last_us,
    round((last_value - lag(last_value) OVER w) / ((last_us - lag(last_us) OVER w) / 3.6e9), 6) + 0.0 AS rate_of_change FROM g WINDOW w AS (PARTITION BY metric_name ORDER BY b)""")
def st2(spark, root):
    return jobs.drain(jobs.running_metrics(as_files(fx.metrics(spark, root), "metrics")), "running")


SLIDE = f"""b AS (SELECT operation, is_error, unnest([0, 1, 2, 3]) AS s, {TS} FROM op_log), w AS (SELECT operation, is_error, time_bucket(INTERVAL 6 HOURS, {TS}, TIMESTAMP '1970-01-01 00:00:00') - to_hours(CAST(6 * s AS INT)) AS window_start FROM b)"""


def monitored(spark, root):
    """Every window of the operation log, the open ones included."""
    return jobs.drain_windows(jobs.operation_monitor(as_files(fx.op_log(spark, root), "ops")), "monitor", ["window_start", "operation"]).read()


@query("st3_operation_monitor", ctes("op_log", extra=SLIDE) + f"""SELECT window_start, window_start + INTERVAL 24 HOURS AS window_end, operation, count(*) AS query_count, count(*) FILTER (is_error) AS error_count FROM w GROUP BY 1, 2, 3""")
def st3(spark, root):
    return monitored(spark, root).drop("p95_ms")


@query("st3_operation_latency", ctes("op_log", extra=SLIDE.replace("operation, is_error", "operation, duration_ms")) + """SELECT window_start, operation, quantile_disc(duration_ms, 0.95) AS p95_ms FROM w GROUP BY 1, 2""")
def st3b(spark, root):
    return monitored(spark, root).select("window_start", "operation", "p95_ms")


@query("st4_error_rates", ctes("op_log", extra=f"w AS (SELECT *, time_bucket(INTERVAL 5 MINUTES, {TS}, TIMESTAMP '1970-01-01 00:00:00') AS window_start FROM op_log)") + f"""SELECT window_start, model_id, count(*) AS request_count,
    round(avg(is_error::INT), 6) AS error_rate, round(avg(duration_ms), 6) AS mean_latency_ms FROM w GROUP BY 1, 2""")
def st4(spark, root):
    return jobs.drain_windows(jobs.error_rates(as_files(fx.op_log(spark, root), "ops")), "rates", ["window_start", "model_id"]).read()


@query("st5_health_rollup", ctes("health") + f"""SELECT date_trunc('hour', {TS}) AS window_start, count(*) AS samples, CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'healthy' END AS overall_status FROM health GROUP BY 1""")
def st5(spark, root):
    return jobs.drain_windows(jobs.health_rollup(as_files(fx.health(spark, root), "health")), "rollup", ["window_start"]).read()


@query("st6_score_arrivals", ctes("obs_weather") + f"SELECT event_id, round({SCORE_SQL}, 6) + 0.0 AS score FROM obs_weather")
def st6(spark, root):
    return jobs.drain(jobs.score_arrivals(as_files(fx.obs_weather(spark, root), "obs")), "scores").select("event_id", "score")


@query("st7_validate_and_load", ctes("raw_dirty") + f"SELECT record_id, CASE WHEN {joined(RAW)} = '' THEN 'loaded' ELSE 'aside' END AS outcome FROM raw_dirty")
def st7(spark, root):
    good, bad = scratch(spark, "loaded"), scratch(spark, "aside")
    jobs.validate_and_load(plain(fx.raw_dirty(spark, root)), "raw", good, bad)
    a = spark.read.parquet(good).select("record_id", F.lit("loaded").alias("outcome"))
    return a.unionByName(spark.read.parquet(bad).select("record_id", F.lit("aside").alias("outcome")))


@query("st7_repair_and_load", ctes("raw_dirty") + "SELECT record_id, TRUE AS rate_ok FROM raw_dirty")
def st7b(spark, root):
    good, bad = scratch(spark, "loaded"), scratch(spark, "aside")
    jobs.validate_and_load(plain(fx.raw_dirty(spark, root)), "raw", good, bad, fix=True)
    return spark.read.parquet(good).select("record_id", F.col("occupancy_rate").between(0, 1).alias("rate_ok"))


@query("st7_load_predictions", ctes("dirty_predictions") + f"SELECT record_id, CASE WHEN {joined(PREDICTION)} = '' THEN 'loaded' ELSE 'aside' END AS outcome FROM dirty_predictions")
def st7c(spark, root):
    good, bad = scratch(spark, "loaded"), scratch(spark, "aside")
    jobs.validate_and_load(plain(fx.dirty_predictions(spark, root)), "prediction", good, bad)
    a = spark.read.parquet(good).select("record_id", F.lit("loaded").alias("outcome"))
    return a.unionByName(spark.read.parquet(bad).select("record_id", F.lit("aside").alias("outcome")))


@query("st7_repair_predictions", ORACLE["dq8_fix_predictions"], digits=11)
def st7d(spark, root):
    """The stream gives what the batch repair gives, however the files arrive."""
    good, bad = scratch(spark, "loaded"), scratch(spark, "aside")
    p = fx.dirty_predictions(spark, root)
    jobs.validate_and_load(plain(p), "prediction", good, bad, fix=True, as_of="2024-02-01 00:00:00", known=p)
    return spark.read.parquet(good).drop("location_id", "batch")


@query("st8_throttled_alerts")
def st8(spark, root):
    a = alerts(as_files(fx.scored_metrics(spark, root), "metrics"), "performance")
    return jobs.drain(jobs.throttle_alerts(a), "alerts")
