"""Queries of the top-k and set families."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.operators import tops as op
from tidemark.registry.core import query
from tidemark.registry.features import TS


@query("tk1_filtered_listing", ctes("metrics") + f"""SELECT event_id, metric_name, value, {TS} FROM metrics WHERE model_id = 'm2' AND metric_name = 'view'
    AND {TS} BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00' ORDER BY {TS} DESC, event_id DESC LIMIT 100""")
def tk1(spark, root):
    return op.listing(fx.metrics(spark, root), "timestamp", {"model_id": "m2", "metric_name": "view"}, "2024-01-03 00:00:00",
                      "2024-01-28 00:00:00", 100, ["event_id"]).drop("model_id")


@query("tk2_worst_predictions", ctes("predictions") + """SELECT order_id, line, part_id, round(actual, 6) AS actual, round(predicted, 6) AS predicted,
    round(abs(actual - predicted), 6) AS abs_error FROM predictions ORDER BY round(abs(actual - predicted), 9) DESC, order_id, line, part_id LIMIT 20""")
def tk2(spark, root):
    p = fx.predictions(spark, root).withColumn("predicted", F.round(F.col("predicted"), 9))
    return op.worst_predictions(p.withColumn("predicted", F.col("actual") - F.round(F.col("actual") - F.col("predicted"), 9)), 20,
                                ties=["order_id", "line", "part_id"]).select("order_id", "line", "part_id", "actual", "predicted",
                                                                             F.round("abs_error", 9).alias("abs_error"))


@query("tk3_best_worst_locations", ctes("predictions") + """, g AS (SELECT location_id, sqrt(avg(pow(actual - predicted, 2))) AS rmse FROM predictions GROUP BY 1)
    SELECT * FROM (SELECT location_id, round(rmse, 6) AS rmse, 'best' AS "group" FROM g ORDER BY g.rmse, location_id LIMIT 3)
    UNION ALL SELECT * FROM (SELECT location_id, round(rmse, 6), 'worst' FROM g ORDER BY g.rmse DESC, location_id LIMIT 3)""")
def tk3(spark, root):
    d = F.col("actual") - F.col("predicted")
    g = fx.predictions(spark, root).groupBy("location_id").agg(F.sqrt(F.avg(d * d)).alias("rmse"))
    return op.best_and_worst(g, "location_id", "rmse", 3)


@query("tk4_top_correlations", ctes("features") + """SELECT variable, round(c, 6) AS correlation FROM (SELECT 'k' AS variable, corr(k, value) AS c FROM features
    UNION ALL SELECT 'load', corr("load", value) FROM features UNION ALL SELECT 'event_id', corr(event_id, value) FROM features) ORDER BY abs(c) DESC, variable LIMIT 2""")
def tk4(spark, root):
    from tidemark.operators.correlation import pearson_with_target

    return op.top_by_absolute(pearson_with_target(fx.features(spark, root), ["k", "load", "event_id"], "value"), "correlation", 2)


@query("tk5_recent_alerts", ctes("health") + f"""SELECT event_id, component, status, {TS} FROM health WHERE status <> 'healthy' ORDER BY {TS} DESC, event_id DESC LIMIT 10""")
def tk5(spark, root):
    h = fx.health(spark, root).where(F.col("status") != "healthy").select("event_id", "component", "status", "timestamp")
    return op.listing(h, "timestamp", limit=10, ties=["event_id"])


@query("tk6_recent_operations", ctes("op_log") + f"""SELECT 'errors' AS what, event_id, operation, duration_ms FROM op_log
    WHERE {TS} > TIMESTAMP '2024-01-20 00:00:00' AND operation = 'click' AND is_error
    UNION ALL SELECT 'all', event_id, operation, duration_ms FROM op_log WHERE {TS} > TIMESTAMP '2024-01-30 00:00:00'""")
def tk6(spark, root):
    log = fx.op_log(spark, root)
    a = op.recent(log, "timestamp", 10 * 1440, datetime(2024, 1, 30), "click", True).withColumn("what", F.lit("errors"))
    b = op.recent(log, "timestamp", 1440, datetime(2024, 1, 31)).withColumn("what", F.lit("all"))
    return a.unionByName(b).select("what", "event_id", "operation", "duration_ms")


@query("tk7_leaderboard", ctes("scored_metrics") + """, g AS (SELECT model_id, metric_name, avg(value) AS value FROM scored_metrics GROUP BY 1, 2)
    SELECT model_id, metric_name, round(value, 6) AS value, rank() OVER (PARTITION BY metric_name ORDER BY CASE WHEN metric_name = 'r2' THEN -value ELSE value END, model_id) AS rank FROM g""")
def tk7(spark, root):
    g = fx.scored_metrics(spark, root).groupBy("model_id", "metric_name").agg(F.avg("value").alias("value"))
    return op.leaderboard(g, "metric_name", "value", "model_id")


@query("so1_union_by_name", ctes("obs", "segments") + f"""SELECT event_id, location_id, {TS}, k, NULL::BIGINT AS level FROM obs
    UNION ALL SELECT event_id, NULL, {TS}, NULL, level FROM segments""")
def so1(spark, root):
    return op.stack(fx.obs(spark, root).select("event_id", "location_id", "timestamp", "k"),
                    fx.segments(spark, root).select("event_id", "timestamp", "level"))


@query("so2_distinct", ctes("metrics", "obs") + """SELECT 'model ' || model_id AS item FROM (SELECT DISTINCT model_id FROM metrics)
    UNION ALL SELECT 'place ' || round(latitude, 4) || ' ' || round(longitude, 4) FROM (SELECT DISTINCT round(latitude, 4) AS latitude, round(longitude, 4) AS longitude FROM obs)""")
def so2(spark, root):
    a = fx.metrics(spark, root).select("model_id").distinct().select(F.concat(F.lit("model "), "model_id").alias("item"))
    b = fx.obs(spark, root).select(F.round("latitude", 4).alias("a"), F.round("longitude", 4).alias("b")).distinct()
    return a.unionByName(b.select(F.concat(F.lit("place "), F.col("a").cast("string"), F.lit(" "), F.col("b").cast("string")).alias("item")))


@query("so3_category_changes", ctes("reference", "current", extra="""r AS (SELECT DISTINCT 'bucket' AS column_name, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS value FROM reference
    UNION SELECT DISTINCT 'zone', zone FROM reference), c AS (SELECT DISTINCT 'bucket' AS column_name, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS value FROM "current"
    UNION SELECT DISTINCT 'zone', zone FROM "current")""") + """SELECT *, 'new' AS change FROM (SELECT * FROM c EXCEPT SELECT * FROM r)
    UNION ALL SELECT *, 'missing' FROM (SELECT * FROM r EXCEPT SELECT * FROM c)""")
def so3(spark, root):
    b = F.floor(F.col("value") / 10).cast("bigint")
    return op.category_changes(fx.reference(spark, root).withColumn("bucket", b), fx.current(spark, root).withColumn("bucket", b), ["bucket", "zone"])


@query("so4_common_keys", """SELECT user_id FROM events WHERE event_type = 'error' AND value > 100 INTERSECT SELECT user_id FROM events WHERE event_type = 'view' AND value > 100""")
def so4(spark, root):
    e = fx.read_table(spark, root, "events").where(F.col("value") > 100)
    return op.common_keys(e.where(F.col("event_type") == "error"), e.where(F.col("event_type") == "view"), "user_id")
