"""Queries of the evaluation, monitoring, maintenance and user-function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.operators import drift as dop
from tidemark.operators import evaluation as op
from tidemark.operators import maintenance as tm
from tidemark.operators import monitoring as mon
from tidemark.operators import udf
from tidemark.operators import windows as win
from tidemark.registry.core import query
from tidemark.registry.drift import NUMERIC
from tidemark.registry.features import TS
from tidemark.registry.windows import PV
from tidemark.sources.tables import Table
from tidemark.sources.writers import scratch

RMSE = "sqrt(sum({w} * pow(actual - predicted, 2)) / sum({w}))"
MAE = "sum({w} * abs(actual - predicted)) / sum({w})"
R2 = "1 - sum({w} * pow(actual - predicted, 2)) / nullif(sum({w} * actual * actual) - pow(sum({w} * actual), 2) / sum({w}), 0)"


def metric_sql(w="1", digits=6):
    return ", ".join(f"round({e.format(w=w)}, {digits}) AS {n}" for n, e in (("rmse", RMSE), ("mae", MAE), ("r2", R2)))


@query("me1_regression_metrics", ctes("predictions") + f"""SELECT 'plain' AS how, model_id, {metric_sql()}, round(avg(abs((actual - predicted) / actual)) FILTER (actual <> 0) * 100, 6) AS mape, count(*) AS sample_size
    FROM predictions GROUP BY 2 UNION ALL SELECT 'weighted', model_id, {metric_sql('line')}, round(avg(abs((actual - predicted) / actual)) FILTER (actual <> 0) * 100, 6), count(*) FROM predictions GROUP BY 2""")
def me1(spark, root):
    p = fx.predictions(spark, root)
    names = ["rmse", "mae", "r2", "mape"]
    a = op.regression_metrics(p, ["model_id"], names=names).withColumn("how", F.lit("plain"))
    return a.unionByName(op.regression_metrics(p, ["model_id"], weight="line", names=names).withColumn("how", F.lit("weighted")))


CONF = """cl AS (SELECT CAST(floor(actual / 15) AS BIGINT) AS a, CAST(floor(predicted / 15) AS BIGINT) AS p FROM predictions),
    k AS (SELECT a AS c FROM cl UNION SELECT p FROM cl), s AS (SELECT c, (SELECT count(*) FROM cl WHERE a = c) AS support, (SELECT count(*) FROM cl WHERE p = c) AS called,
    (SELECT count(*) FROM cl WHERE a = c AND p = c) AS tp FROM k), t AS (SELECT *, CASE WHEN called > 0 THEN tp / called::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS re FROM s)"""


@query("me2_classification_metrics", ctes("predictions", extra=CONF) + """SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(support * pr) / sum(support), 6) AS precision,
    round(sum(support * re) / sum(support), 6) AS recall, round(sum(support * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) / sum(support), 6) AS f1 FROM t""")
def me2(spark, root):
    p = fx.predictions(spark, root).select(F.floor(F.col("actual") / 15).alias("a"), F.floor(F.col("predicted") / 15).alias("p"))
    return op.classification_metrics(p.withColumnsRenamed({"a": "truth", "p": "guess"}), "truth", "guess")


@query("me3_bootstrap_interval")
def me3(spark, root):
    return op.bootstrap_interval(fx.predictions(spark, root), ["order_id", "line", "part_id"])


KSQ = """m AS (SELECT count(*)::DOUBLE AS n, avg(pow(e - mu, 3)) / pow(avg(pow(e - mu, 2)), 1.5) AS g1, avg(pow(e - mu, 4)) / pow(avg(pow(e - mu, 2)), 2) AS b2
    FROM (SELECT predicted - actual AS e, avg(predicted - actual) OVER () AS mu FROM predictions)),
    a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
    (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM m),
    b AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS t, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS big FROM a),
    c AS (SELECT *, ln(t + sqrt(t * t + 1)) / sqrt(0.5 * ln(w2)) AS z1, 1 + x * sqrt(2 / (big - 4)) AS den FROM b),
    d AS (SELECT n, z1 * z1 + pow((1 - 2 / (9 * big) - sign(den) * pow((1 - 2 / big) / abs(den), 1.0 / 3)) / sqrt(2 / (9 * big)), 2) AS k2 FROM c)"""


@query("me4_residual_normality", ctes("predictions", extra=KSQ) + "SELECT round(k2, 4) AS k2, round(exp(-k2 / 2), 4) AS p_value, CAST(n AS BIGINT) AS sample_size FROM d", digits=4)
def me4(spark, root):
    return op.normality(fx.predictions(spark, root), F.col("predicted") - F.col("actual"))


@query("me5_heteroscedasticity", ctes("predictions") + "SELECT model_id, round(abs(corr(pow(predicted - actual, 2), actual)), 6) AS heteroscedasticity FROM predictions GROUP BY 1")
def me5(spark, root):
    return op.heteroscedasticity(fx.predictions(spark, root), keys=["model_id"])


@query("me6_durbin_watson", ctes("predictions", extra=f"""s AS (SELECT predicted - actual AS e, predicted - actual - lag(predicted - actual) OVER (ORDER BY {TS}, order_id, line, part_id, location_id, actual, predicted) AS d FROM predictions)""")
       + "SELECT round(sum(d * d) / sum(e * e), 6) AS durbin_watson FROM s")
def me6(spark, root):
    return op.durbin_watson(fx.predictions(spark, root), "timestamp", ["order_id", "line", "part_id", "location_id", "actual", "predicted"])


@query("me7_threshold_violations", ctes("scored_metrics", extra="t AS (SELECT event_id, value, 0.4::DOUBLE + event_id % 3 * 0.2 AS threshold FROM scored_metrics), v AS (SELECT *, value > threshold AS is_violated, CASE WHEN value > threshold THEN value - threshold ELSE 0 END AS m FROM t)")
       + """SELECT event_id, is_violated, round(m, 6) AS violation_margin, CASE WHEN m / threshold < 0.1 THEN 'LOW' WHEN m / threshold < 0.25 THEN 'MEDIUM' WHEN m / threshold < 0.5 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM v""")
def me7(spark, root):
    t = fx.scored_metrics(spark, root).select("event_id", "value", (F.lit(0.4) + F.col("event_id") % 3 * F.lit(0.2)).alias("threshold"))
    return op.threshold_violations(t, "value", "threshold", ">").drop("value", "threshold")


@query("me8_window_metrics", ctes("predictions", extra=f"""dd AS (SELECT d, (row_number() OVER (ORDER BY d) - 1) // 28 AS window_idx, count(*) OVER () AS n FROM (SELECT DISTINCT CAST({TS} AS DATE) AS d FROM predictions)),
    dw AS (SELECT d, window_idx, min(d) OVER (PARTITION BY window_idx) AS window_start, max(d) OVER (PARTITION BY window_idx) AS window_end FROM dd WHERE (window_idx + 1) * 28 <= n),
    x AS (SELECT p.*, dw.* EXCLUDE (d) FROM predictions p JOIN dw ON CAST(p.{TS} AS DATE) = dw.d), y AS (SELECT model_id AS model, * FROM x UNION ALL SELECT 'location_' || location_id, * FROM x)""") + f"""
    SELECT window_idx, window_start, window_end, model, {metric_sql(digits=5)}, count(*) AS sample_size FROM y GROUP BY 1, 2, 3, 4""", digits=5)
def me8(spark, root):
    return op.window_metrics(fx.predictions(spark, root), days=28)


MEANS = f"""g AS (SELECT metric_name, model_id, avg(value) AS v FROM scored_metrics WHERE {TS} > TIMESTAMP '2024-01-23 00:00:00' AND {TS} <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY CASE WHEN metric_name = 'r2' THEN -v ELSE v END, model_id) AS rk FROM g)"""


@query("me9_compare_models", ctes("scored_metrics", extra=MEANS) + """SELECT metric_name, max(model_id) FILTER (rk = 1) AS best_model, round(max(v) FILTER (rk = 1), 6) AS best_value,
    round(abs((max(v) FILTER (rk = 1) - max(v) FILTER (rk = 2)) / max(v) FILTER (rk = 2)) * 100, 6) AS improvement, count(*) AS models FROM r GROUP BY 1""")
def me9(spark, root):
    return op.compare_models(fx.scored_metrics(spark, root), "2024-01-30 00:00:00")


@query("me10_rank_models", ctes("scored_metrics", extra="""g AS (SELECT metric_name, model_id, avg(value) AS v FROM scored_metrics WHERE metric_name IN ('rmse', 'r2', 'mae') GROUP BY 1, 2),
    n AS (SELECT *, (v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) AS x FROM g WINDOW p AS (PARTITION BY metric_name)),
    s AS (SELECT model_id, sum(CASE metric_name WHEN 'r2' THEN x * 0.5 WHEN 'rmse' THEN (1 - x) * 0.3 ELSE (1 - x) * 0.2 END) AS score FROM n GROUP BY 1)""") + "SELECT model_id, round(score / (SELECT max(score) FROM s), 6) AS score FROM s")
def me10(spark, root):
    return op.rank_models(fx.scored_metrics(spark, root), {"r2": 0.5, "rmse": 0.3, "mae": 0.2})


ALERTS = f"""al AS (SELECT 'performance_' || model_id || '_' || metric_name || '_' || epoch_us({TS}) || '_' || event_id AS id, 'warning' AS severity, {TS}, metric_name, model_id,
    CASE metric_name WHEN 'rmse' THEN 1.0 WHEN 'mae' THEN 0.8 ELSE 0.7 END::DOUBLE AS threshold_value, round(value, 6) AS current_value FROM scored_metrics
    WHERE (metric_name = 'rmse' AND value > 1.0) OR (metric_name = 'mae' AND value > 0.8) OR (metric_name = 'r2' AND value < 0.7))"""


def _alerts(spark, root):
    return mon.alerts(fx.scored_metrics(spark, root), "performance", keys=["event_id"])


@query("me11_alerts", ctes("scored_metrics", "health", extra=ALERTS) + f"""SELECT id, severity, {TS}, metric_name, model_id, threshold_value, current_value FROM al
    UNION ALL SELECT 'health_' || component || '_error_rate_' || epoch_us({TS}) || '_' || event_id, 'critical', {TS}, 'error_rate', component, 0.01, error_rate FROM health WHERE error_rate > 0.01""")
def me11(spark, root):
    h = fx.health(spark, root).select("event_id", F.col("component").alias("model_id"), "timestamp", F.lit("error_rate").alias("metric_name"),
                                      F.col("error_rate").alias("value"))
    return _alerts(spark, root).unionByName(mon.alerts(h, "health", keys=["event_id"])).drop("message", "is_acknowledged")


@query("me12_active_alerts", ctes("scored_metrics", extra=ALERTS) + f"""SELECT id, metric_name, {TS} FROM al WHERE model_id = 'm1' AND severity = 'warning' AND {TS} >= TIMESTAMP '2024-01-10 00:00:00' AND metric_name <> 'mae'""")
def me12(spark, root):
    a = _alerts(spark, root).withColumn("is_acknowledged", F.col("metric_name") == "mae")
    return mon.active_alerts(a, "m1", "warning", "2024-01-10 00:00:00").select("id", "metric_name", "timestamp")


@query("me13_health_summary", ctes("health", extra=f"""g AS (SELECT component, avg(latency_ms) AS l, avg(error_rate) AS e, avg(memory_mb) AS m, avg(cpu_percent) AS c, count(*) AS n FROM health
    WHERE {TS} BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-21 00:00:00' GROUP BY 1),
    s AS (SELECT *, (greatest(0, 1 - l / 100) + greatest(0, 1 - e / 0.05) + greatest(0, 1 - m / 1000) + greatest(0, 1 - c / 80)) / 4 AS hs FROM g)""") + """SELECT component, round(l, 6) AS avg_latency_ms,
    round(e, 6) AS avg_error_rate, round(m, 6) AS avg_memory_mb, round(c, 6) AS avg_cpu_percent, n AS sample_size, round(hs, 6) AS health_score, CASE WHEN hs >= 0.8 THEN 'healthy' WHEN hs >= 0.5 THEN 'degraded' ELSE 'unhealthy' END AS status,
    l > 100 AS latency_ms_exceeded, e > 0.05 AS error_rate_exceeded, m > 1000 AS memory_mb_exceeded, c > 80 AS cpu_percent_exceeded FROM s""")
def me13(spark, root):
    limits = mon.HEALTH_LIMITS | {"error_rate": 0.05}
    return mon.health_summary(fx.health(spark, root), "component", "2024-01-21 00:00:00", 1440, limits=limits)


@query("me14_component_health", ctes("health") + f"""SELECT component, day, health, CASE WHEN health >= 80 THEN 'Healthy' WHEN health >= 60 THEN 'Warning' ELSE 'Critical' END AS label FROM (
    SELECT component, day, CAST(floor(avg(s) + 0.5) AS BIGINT) AS health FROM (SELECT component, CAST({TS} AS DATE) AS day, 100 - least(greatest(cpu_percent, 0.0), 100.0) AS s FROM health
    UNION ALL SELECT component, CAST({TS} AS DATE), 100 - least(greatest(latency_ms, 0.0), 100.0) / 2 FROM health UNION ALL SELECT component, CAST({TS} AS DATE), least(greatest(memory_mb, 0.0), 100.0) FROM health) GROUP BY 1, 2)""")
def me14(spark, root):
    h = fx.health(spark, root).select("component", F.to_date("timestamp").alias("day"), F.col("cpu_percent").alias("cpu_usage"),
                                      F.col("latency_ms").alias("inference_time"), F.col("memory_mb").alias("throughput"))
    return mon.component_health(h.unpivot(["component", "day"], ["cpu_usage", "inference_time", "throughput"], "metric_name", "value"), ["component", "day"])


@query("me15_overall_status", ctes("health") + f"""SELECT date_trunc('hour', {TS}) AS hour, CASE WHEN bool_or(status = 'critical') THEN 'critical' WHEN bool_or(status = 'degraded') THEN 'degraded'
    WHEN bool_and(status = 'healthy') THEN 'healthy' ELSE 'unknown' END AS overall_status FROM health GROUP BY 1""")
def me15(spark, root):
    return mon.overall_status(fx.health(spark, root).withColumn("hour", F.date_trunc("hour", "timestamp")), ["hour"])


@query("me16_store_health", ctes("op_log", extra="""s AS (SELECT operation, is_error, duration_ms, row_number() OVER (PARTITION BY operation ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY operation) AS n FROM op_log),
    g AS (SELECT operation, count(*) AS query_count, count(*) FILTER (is_error) AS error_count, max(duration_ms) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95 FROM s GROUP BY 1)""") + """
    SELECT operation, query_count, error_count, p95 AS p95_latency_ms, round(error_count / query_count::DOUBLE, 6) AS error_rate,
    coalesce(concat_ws(';', CASE WHEN error_count / query_count::DOUBLE > 0.1 THEN 'error rate exceeds threshold' END, CASE WHEN p95 > 150 THEN 'p95 latency exceeds threshold' END), '') AS issues,
    CASE WHEN error_count / query_count::DOUBLE > 0.1 OR p95 > 150 THEN 'warning' ELSE 'normal' END AS alert_level,
    CASE WHEN error_count / query_count::DOUBLE > 0.1 OR p95 > 150 THEN 'degraded' ELSE 'healthy' END AS status FROM g""")
def me16(spark, root):
    return mon.store_health(fx.op_log(spark, root), ["operation"], 0.1, 150.0).withColumn("issues", F.array_join("issues", ";"))


STATUS = f"""st AS (SELECT CAST({TS} AS DATE) AS day, category, avg(k) / 100 AS quality_score, avg((k > 90)::INT) AS missing_rate, max(value) / 400 AS drift_magnitude,
    count(*) FILTER (k > 60) AS false_positives, count(*) FILTER (k < 25) AS false_negatives, avg((value > 150)::INT) AS error_rate, avg(value) * 2 AS latency_ms FROM features GROUP BY 1, 2)"""


@query("me17_recommended_actions", ctes("features", extra=STATUS) + """SELECT day, category, 'clean_data' AS action_type, 2::BIGINT AS priority, 'data_quality' AS issue_source, 0.9::DOUBLE AS confidence FROM st WHERE quality_score < 0.8
    UNION ALL SELECT day, category, 'feature_investigation', 3, 'data_quality', 0.85 FROM st WHERE missing_rate > 0.1 UNION ALL SELECT day, category, 'retrain', 1, 'performance', 0.95 FROM st WHERE drift_magnitude > 0.7
    UNION ALL SELECT day, category, 'adjust_thresholds', 2, 'performance', 0.85 FROM st WHERE false_positives > 2 * false_negatives
    UNION ALL SELECT day, category, 'alert_escalation', 1, 'health', 0.98 FROM st WHERE error_rate > 0.05 UNION ALL SELECT day, category, 'alert_escalation', 2, 'health', 0.9 FROM st WHERE latency_ms > 100""")
def me17(spark, root):
    f = fx.features(spark, root).groupBy(F.to_date("timestamp").alias("day"), "category").agg(
        (F.avg("k") / 100).alias("quality_score"), F.avg((F.col("k") > 90).cast("int")).alias("missing_rate"), (F.max("value") / 400).alias("drift_magnitude"),
        F.count_if(F.col("k") > 60).alias("false_positives"), F.count_if(F.col("k") < 25).alias("false_negatives"),
        F.avg((F.col("value") > 150).cast("int")).alias("error_rate"), (F.avg("value") * 2).alias("latency_ms"))
    return mon.recommend_actions(f, ["day", "category"]).orderBy("priority")


WINDOWS = """wd AS (SELECT 'model_' || c_custkey AS model_id, CASE WHEN c_custkey % 3 = 0 THEN 1 + c_custkey % 28 END AS day_of_month, CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 7 END AS day_of_week,
    CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 24 END AS hour, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 4 * 15 END AS minute,
    TIMESTAMP '2024-01-10 00:00:00' - to_days(CAST(c_custkey % 60 AS INT)) AS last_trained FROM customer)"""


def windows_table(spark, root):
    k = F.col("c_custkey")
    return fx.read_table(spark, root, "customer").select(
        F.concat(F.lit("model_"), k.cast("string")).alias("model_id"), F.when(k % 3 == 0, 1 + k % 28).alias("day_of_month"),
        F.when(k % 3 == 1, k % 7).alias("day_of_week"), F.when(k % 3 < 2, k % 24).alias("hour"), F.when(k % 3 < 2, k % 4 * 15).alias("minute"),
        F.timestamp_micros(F.unix_micros(F.lit("2024-01-10").cast("timestamp")) - k % 60 * 86_400_000_000).alias("last_trained"))


SLOTS = """sl AS (SELECT model_id, d + to_minutes(CAST(hour * 60 + minute AS INT)) AS tm FROM wd, (SELECT unnest(generate_series(TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-04-15 00:00:00', INTERVAL 1 DAY)) AS d)
    WHERE hour IS NOT NULL AND CASE WHEN day_of_month IS NOT NULL THEN day(d) = day_of_month WHEN day_of_week IS NOT NULL THEN isodow(d) - 1 = day_of_week END)"""


@query("me18_retraining_due", f"WITH {WINDOWS}, {SLOTS}, nx AS (SELECT model_id, min(tm) AS tm FROM sl WHERE tm > TIMESTAMP '2024-01-15 10:30:00' GROUP BY 1)" + """
    SELECT model_id, CASE WHEN hour IS NULL THEN date_diff('second', last_trained, TIMESTAMP '2024-01-15 10:30:00') // 86400 >= 30
    ELSE (day_of_month IS NULL OR day_of_month = 15) AND (day_of_week IS NULL OR day_of_week = 0) AND hour = 10 AND minute = 30 END AS is_due,
    CASE WHEN hour IS NULL THEN greatest(last_trained + INTERVAL 30 DAYS, TIMESTAMP '2024-01-15 10:30:00') ELSE nx.tm END AS next_window FROM wd LEFT JOIN nx USING (model_id)""")
def me18(spark, root):
    return mon.retraining_due(windows_table(spark, root), "2024-01-15 10:30:00")


@query("me19_schedule", f"WITH {WINDOWS}, {SLOTS}" + " SELECT model_id, tm AS scheduled_at FROM sl WHERE tm > TIMESTAMP '2024-01-15 10:30:00' AND tm <= TIMESTAMP '2024-02-14 10:30:00'")
def me19(spark, root):
    return mon.schedule(windows_table(spark, root), "2024-01-15 10:30:00", 30)


HISTORY = f"""hs AS (SELECT 'm' || (event_id % 50) AS model_id, {TS} + INTERVAL 2 DAYS AS scheduled_date, 10 + k / 2 AS interval_days, {TS} AS updated_at FROM features),
    ls AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY updated_at DESC) = 1),
    dm AS (SELECT 'm' || (event_id % 50) AS model_id, avg(CASE WHEN event_id % 50 < 40 THEN value / 100 END) AS m FROM features GROUP BY 1),
    pf AS (SELECT 'm' || (event_id % 50) AS model_id, avg(CASE WHEN ch > 0 THEN least(ch, 2.0) END) AS g FROM (SELECT event_id, CASE metric_name WHEN 'r2' THEN (previous - value) / 0.05
    WHEN 'rmse' THEN CASE WHEN previous > 0 THEN (value - previous) / previous / 0.15 END WHEN 'mae' THEN CASE WHEN previous > 0 THEN (value - previous) / previous / 0.15 END END AS ch FROM pv) GROUP BY 1),
    fc AS (SELECT ls.*, CASE WHEN m > 0.5 THEN 0.5 WHEN m > 0.3 THEN 0.75 WHEN m < 0.1 THEN 1.25 ELSE 1.0 END::DOUBLE AS df, CASE WHEN g > 1.5 THEN 0.5 WHEN g > 1 THEN 0.75 WHEN g > 0.5 THEN 0.9 ELSE 1.0 END::DOUBLE AS pf
    FROM ls LEFT JOIN dm USING (model_id) LEFT JOIN pf USING (model_id)), nd AS (SELECT *, least(greatest(interval_days * df * pf, 7.0), 60.0) AS ni FROM fc)"""


@query("me20_adaptive_schedule", ctes("features", "scored_metrics", extra=PV + ", " + HISTORY) + """SELECT model_id, df AS drift_factor, pf AS performance_factor, round(ni, 6) AS next_interval,
    make_timestamp(CAST(trunc(epoch_us(scheduled_date) + ni * 86400000000) AS BIGINT)) AS next_date, scheduled_date <= TIMESTAMP '2024-01-31 12:00:00' AS is_due FROM nd""")
def me20(spark, root):
    name = F.concat(F.lit("m"), (F.col("event_id") % 50).cast("string"))
    f = fx.features(spark, root)
    history = f.select(name.alias("model_id"), (F.col("timestamp") + F.expr("interval 2 days")).alias("scheduled_date"),
                       (10 + F.col("k") / 2).alias("interval_days"), F.col("timestamp").alias("updated_at"))
    # some models have no drift report
    drift = f.select(name.alias("model_id"), F.when(F.col("event_id") % 50 < 40, F.col("value") / 100).alias("ks_statistic"))
    runs = win.degradation(fx.scored_metrics(spark, root), ["model_id"], "timestamp", "metric_name", "value", ["event_id"]).withColumn("model_id", name)
    return mon.adaptive_schedule(history, drift, runs, "2024-01-31 12:00:00")


@query("me21_verdict", ctes("reference", "current", "scored_metrics", extra=NUMERIC + ", " + PV + ", " + WINDOWS) + f"""SELECT dd AS drift_detected, gg AS degradation_detected, mm AS models_due, dd OR gg OR mm > 0 AS retraining_triggered,
    nullif(concat_ws('; ', CASE WHEN dd THEN 'data drift' END, CASE WHEN gg THEN 'performance degradation' END, CASE WHEN mm > 0 THEN 'scheduled retraining' END), '') AS retraining_reason, TIMESTAMP '2024-01-15 10:30:00' AS "timestamp" FROM
    (SELECT bool_or(d > 0.1 OR md > 0.2 OR sd > 0.2) AS dd FROM nd), (SELECT bool_or(CASE WHEN metric_name = 'r2' THEN previous - value > 0.05 WHEN metric_name IN ('rmse', 'mae') THEN (value - previous) / nullif(previous, 0) > 0.1 END) AS gg FROM pv),
    (SELECT count(*) AS mm FROM wd WHERE CASE WHEN hour IS NULL THEN date_diff('second', last_trained, TIMESTAMP '2024-01-15 10:30:00') // 86400 >= 30
    ELSE (day_of_month IS NULL OR day_of_month = 15) AND (day_of_week IS NULL OR day_of_week = 0) AND hour = 10 AND minute = 30 END)""")
def me21(spark, root):
    d = dop.drift_decision(dop.numeric_drift(fx.current(spark, root), dop.baseline_profile(fx.reference(spark, root), ["value", "k", "load"])))
    g = win.degradation(fx.scored_metrics(spark, root), ["model_id"], "timestamp", "metric_name", "value", ["event_id"])
    return mon.verdict(d, g, mon.retraining_due(windows_table(spark, root), "2024-01-15 10:30:00"), "2024-01-15 10:30:00")


@query("me22_feature_set_impact", ctes("predictions", extra=f"m AS (SELECT model_id, {RMSE.format(w='1')} AS rmse, {R2.format(w='1')} AS r2 FROM predictions GROUP BY 1)") + """SELECT
    round((a.r2 - b.r2) / b.r2 * 100, 6) + 0.0 AS feature_r2_gain_pct, round((b.rmse - a.rmse) / b.rmse * 100, 6) + 0.0 AS feature_rmse_gain_pct, round((l.r2 - a.r2) / a.r2 * 100, 6) + 0.0 AS location_r2_gain_pct,
    round((a.rmse - l.rmse) / a.rmse * 100, 6) + 0.0 AS location_rmse_gain_pct FROM m b, m a, m l WHERE b.model_id = 'N' AND a.model_id = 'A' AND l.model_id = 'R'""")
def me22(spark, root):
    m = op.regression_metrics(fx.predictions(spark, root), ["model_id"], names=["rmse", "r2"])
    key = F.when(F.col("model_id") == "N", "global_basic").when(F.col("model_id") == "A", "global_advanced").otherwise("location_advanced")
    return op.feature_set_impact(m.withColumn("key", key))


@query("me23_fold_summary", ctes("predictions", extra=f"p AS (SELECT order_id % 5 AS fold, * FROM predictions), f AS (SELECT fold, {metric_sql().replace('round(', '(').replace(', 6)', ')')}, count(*) AS n FROM p GROUP BY 1)") + f"""
    SELECT 'mean' AS kind, round(avg(rmse), 6) AS rmse, round(avg(r2), 6) AS r2, round(avg(mae), 6) AS mae FROM f
    UNION ALL SELECT 'weighted', round(sum(rmse * n) / sum(n), 6), round(sum(r2 * n) / sum(n), 6), round(sum(mae * n) / sum(n), 6) FROM f
    UNION ALL SELECT 'pooled', round({RMSE.format(w='1')}, 6), round({R2.format(w='1')}, 6), round({MAE.format(w='1')}, 6) FROM p""")
def me23(spark, root):
    return op.fold_summary(fx.predictions(spark, root).withColumn("fold", F.col("order_id") % 5))


@query("tm1_update_by_id", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 20 = 3 THEN 0.0 ELSE o_totalprice END AS price FROM orders""")
def tm1(spark, root):
    t = fx.read_table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    stored = Table.create(t, scratch(spark, "orders"), "id", 4)
    stored.update(t.where(F.col("id") % 10 == 3).select("id", F.lit("done").alias("status"), F.when(F.col("id") % 20 == 3, 0.0).alias("price")))
    return stored.read()


@query("tm1_upsert", """SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey + 10000000, -1.0 FROM orders WHERE o_orderkey % 10 = 3""")
def tm1b(spark, root):
    t = fx.read_table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    stored = Table.create(t, scratch(spark, "orders"), "id", 4)
    ch = t.where(F.col("id") % 10 == 3).select("id", F.lit(-1.0).alias("price"))
    stored.upsert(ch.unionByName(ch.withColumn("id", F.col("id") + 10_000_000)))
    return stored.read()


@query("tm2_delete_by_id", "SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def tm2(spark, root):
    t = fx.read_table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    stored = Table.create(t, scratch(spark, "orders"), "customer", 4)
    stored.delete(fx.read_table(spark, root, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("customer")))
    return stored.read().select("id")


@query("tm3_retention", ctes("metrics") + f"SELECT count(*) FILTER ({TS} >= TIMESTAMP '2024-01-21 00:00:00') AS kept, count(*) FILTER ({TS} < TIMESTAMP '2024-01-21 00:00:00') AS deleted FROM metrics")
def tm3(spark, root):
    return tm.retention_report(fx.metrics(spark, root), "timestamp", "2024-01-31 00:00:00", 10)


@query("tm3_retained_rows", ctes("metrics") + f"SELECT event_id FROM metrics WHERE {TS} >= TIMESTAMP '2024-01-21 00:00:00'")
def tm3b(spark, root):
    stored = Table.create(fx.metrics(spark, root).select("event_id", "timestamp"), scratch(spark, "metrics"), "event_id", 1, "timestamp")
    stored.retain("2024-01-31 00:00:00", 10)
    return stored.read().select("event_id")


@query("tm4_copy_with_view", ctes("health") + "SELECT event_id, component AS service, status FROM health")
def tm4(spark, root):
    tm.copy_with_view(fx.health(spark, root).select("event_id", "component", "status"), scratch(spark, "copy"), "service_health", {"component": "service"})
    return spark.sql("SELECT event_id, service, status FROM service_health")


@query("ud1_apply_by_partition", ctes("obs") + "SELECT event_id, round(occupancy * 2 + k, 6) AS score FROM obs")
def ud1(spark, root):
    def score(pdf):
        return pdf.assign(score=pdf["occupancy"] * 2 + pdf["k"])[["event_id", "score"]]

    return udf.apply_by_partition(fx.obs(spark, root).select("event_id", "occupancy", "k"), score, "event_id long, score double")


@query("ud2_metric_registry", ctes("predictions") + f"SELECT model_id, round({RMSE.format(w='1')}, 6) AS rmse, round(avg(predicted - actual), 6) + 0.0 AS bias, round(sqrt(avg(pow(abs(actual - predicted), 1.5))), 6) AS soft, count(*) AS sample_size FROM predictions GROUP BY 1")
def ud2(spark, root):
    udf.register_sum_metric("bias", lambda y, p: p - y)
    udf.register_sum_metric("soft", lambda y, p: F.pow(F.abs(y - p), F.lit(1.5)), F.sqrt)
    return udf.evaluate(fx.predictions(spark, root), ["rmse", "bias", "soft"], ["model_id"])
