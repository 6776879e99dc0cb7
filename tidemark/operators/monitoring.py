"""Alerts, health, recommended actions and retraining schedules as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.aggs import latency_rank_stats
from tidemark.operators.windows import HIGHER_BETTER, LOWER_BETTER, latest
from tidemark.plans.scalars import with_row

# Alert limits per kind of metric.
ALERT_LIMITS = {
    "performance": {"rmse": 1.0, "mae": 0.8, "r2": 0.7},
    "drift": {"feature_drift": 0.05, "concept_drift": 0.05, "error_ratio": 1.5},
    "health": {"prediction_latency_ms": 100.0, "error_rate": 0.01, "memory_usage_mb": 1000.0},
}


def _lookup(key: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, v in table.items():
        out = F.when(key == name, F.lit(float(v))).otherwise(out)
    return out


def alerts(df: DataFrame, kind: str, metric: str = "metric_name", value: str = "value", model: str = "model_id", time: str = "timestamp",
           limits: dict[str, float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One alert row per measurement beyond its limit (R² below, everything else above)."""
    limit = _lookup(F.col(metric), limits or ALERT_LIMITS[kind])
    d = df.withColumn("threshold_value", limit).where(F.col("threshold_value").isNotNull())
    hit = F.when(F.col(metric) == "r2", F.col(value) < F.col("threshold_value")).otherwise(F.col(value) > F.col("threshold_value"))
    severity = F.when((F.lit(kind) == "health") & (F.col(metric) == "error_rate"), "critical").otherwise("warning")
    ident = F.concat_ws("_", F.lit(kind), F.col(model), F.col(metric), F.unix_micros(time).cast("string"), *keys)
    return d.where(hit).select(
        ident.alias("id"), severity.alias("severity"), F.concat(F.lit(f"{kind} metric "), F.col(metric), F.lit(" exceeded threshold")).alias("message"),
        F.col(time).alias("timestamp"), F.col(metric).alias("metric_name"), F.col(model).alias("model_id"), "threshold_value",
        F.col(value).alias("current_value"), F.lit(False).alias("is_acknowledged"))


def active_alerts(df: DataFrame, model_id: str | None = None, severity: str | None = None, since: str | None = None) -> DataFrame:
    out = df.where(~F.col("is_acknowledged"))
    if model_id is not None:
        out = out.where(F.col("model_id") == model_id)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    return out if since is None else out.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))


def acknowledge(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.withColumn("is_acknowledged", F.col("is_acknowledged") | F.col("id").isin(list(ids)))


# Limits of the health score.
HEALTH_LIMITS = {"latency_ms": 100.0, "error_rate": 0.01, "memory_mb": 1000.0, "cpu_percent": 80.0}


def health_summary(df: DataFrame, key: str, as_of: str, minutes: int = 5, time: str = "timestamp", limits: dict[str, float] = HEALTH_LIMITS) -> DataFrame:
    """Averages of the window, score = mean of max(0, 1 - average / limit), status and breaches."""
    end = F.lit(as_of).cast("timestamp")
    w = df.where((F.col(time) >= end - F.expr(f"interval {minutes} minutes")) & (F.col(time) <= end))
    g = w.groupBy(key).agg(*[F.avg(c).alias(f"avg_{c}") for c in limits], F.count(F.lit(1)).alias("sample_size"))
    score = sum((F.greatest(F.lit(0.0), 1 - F.col(f"avg_{c}") / limit) for c, limit in limits.items()), F.lit(0.0)) / len(limits)
    g = g.withColumn("health_score", score)
    status = F.when(F.col("health_score") >= 0.8, "healthy").when(F.col("health_score") >= 0.5, "degraded").otherwise("unhealthy")
    return g.withColumn("status", status).withColumns({f"{c}_exceeded": F.col(f"avg_{c}") > limit for c, limit in limits.items()})


def component_health(df: DataFrame, keys: Sequence[str], metric: str = "metric_name", value: str = "value") -> DataFrame:
    """Rounded mean of the 0-100 scores (inverted for load, halved and inverted for inference time) and label."""
    v = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(100.0))
    score = F.when(F.col(metric).isin("cpu_usage", "memory_usage"), 100 - v).when(F.col(metric) == "inference_time", 100 - v / 2).otherwise(v)
    g = df.groupBy(*keys).agg(F.floor(F.avg(score) + 0.5).alias("health"))
    return g.withColumn("label", F.when(F.col("health") >= 80, "Healthy").when(F.col("health") >= 60, "Warning").otherwise("Critical"))


def overall_status(df: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Worst status of the components: critical, degraded, all healthy, else unknown."""
    s = F.col(status)
    g = df.groupBy(*keys).agg(F.bool_or(s == "critical").alias("c"), F.bool_or(s == "degraded").alias("d"), F.bool_and(s == "healthy").alias("h"))
    out = F.when(F.col("c"), "critical").when(F.col("d"), "degraded").when(F.col("h"), "healthy").otherwise("unknown")
    return g.select(*keys, out.alias("overall_status"))


def store_health(log: DataFrame, keys: Sequence[str] = (), error_limit: float = 0.05, p95_limit_ms: float = 1000.0) -> DataFrame:
    """Error rate and nearest-rank p95 against their limits with the list of issues."""
    c = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("query_count"), F.count_if("is_error").alias("error_count"))
    p = latency_rank_stats(log, "duration_ms", keys).select(*keys, F.col("p95").alias("p95_latency_ms"))
    g = c.join(p, list(keys)) if keys else with_row(c, p, "__p").select("query_count", "error_count", "__p.p95_latency_ms")
    rate = F.col("error_count") / F.greatest(F.col("query_count"), F.lit(1))
    issues = F.array_compact(F.array(F.when(rate > error_limit, F.lit("error rate exceeds threshold")),
                                     F.when(F.col("p95_latency_ms") > p95_limit_ms, F.lit("p95 latency exceeds threshold"))))
    g = g.withColumn("error_rate", rate).withColumn("issues", issues)
    return g.withColumn("alert_level", F.when(F.size("issues") > 0, "warning").otherwise("normal")).withColumn(
        "status", F.when(F.size("issues") > 0, "degraded").otherwise("healthy"))


# Limits of the recommended actions.
ACTION_LIMITS = {"quality": 0.8, "missing": 0.1, "drift": 0.7, "error_rate": 0.05, "latency_ms": 100.0}


def recommend_actions(df: DataFrame, keys: Sequence[str], limits: dict[str, float] = ACTION_LIMITS) -> DataFrame:
    """Action rows of each status row (quality_score, missing_rate, drift_magnitude, false_positives,
    false_negatives, error_rate, latency_ms), by priority."""
    def c(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    def act(cond, kind, priority, source, conf):
        return F.when(cond, F.struct(F.lit(kind).alias("action_type"), F.lit(priority).cast("bigint").alias("priority"),
                                     F.lit(source).alias("issue_source"), F.lit(conf).alias("confidence")))

    found = F.array_compact(F.array(
        act(c("quality_score", 1.0) < limits["quality"], "clean_data", 2, "data_quality", 0.9),
        act(c("missing_rate", 0.0) > limits["missing"], "feature_investigation", 3, "data_quality", 0.85),
        act(c("drift_magnitude", 0.0) > limits["drift"], "retrain", 1, "performance", 0.95),
        act(c("false_positives", 0) > c("false_negatives", 0) * 2, "adjust_thresholds", 2, "performance", 0.85),
        act(c("error_rate", 0.0) > limits["error_rate"], "alert_escalation", 1, "health", 0.98),
        act(c("latency_ms", 0.0) > limits["latency_ms"], "alert_escalation", 2, "health", 0.9)))
    return df.select(*keys, F.explode(found).alias("a")).select(*keys, "a.*")


def action_history(actions: DataFrame, start: str | None = None, end: str | None = None, kinds: Sequence[str] | None = None,
                   time: str = "timestamp") -> DataFrame:
    if start is not None:
        actions = actions.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        actions = actions.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return actions if not kinds else actions.where(F.col("action_type").isin(list(kinds)))


def _clock_us() -> Column:
    """Time of day of a window in microseconds."""
    return (F.col("hour") * 60 + F.col("minute")).cast("bigint") * 60_000_000


def retraining_due(windows: DataFrame, as_of: str, base_interval: int = 30) -> DataFrame:
    """Whether each model is due at `as_of` and its next window.

    `windows`: model_id, day_of_month, day_of_week, hour, minute, last_trained; no hour means the model
    is scheduled by interval."""
    now = F.lit(as_of).cast("timestamp")
    cal = F.col("hour").isNotNull()
    at_day = (F.col("day_of_month").isNull() | (F.day(now) == F.col("day_of_month"))) & (
        F.col("day_of_week").isNull() | (F.weekday(now) == F.col("day_of_week")))
    calendar_due = at_day & (F.hour(now) == F.col("hour")) & (F.minute(now) == F.col("minute"))
    days = F.floor((F.unix_micros(now) - F.unix_micros("last_trained")) / 86_400_000_000)
    due = F.when(cal, F.coalesce(calendar_due, F.lit(False))).otherwise(days >= base_interval)
    today = F.timestamp_micros(F.unix_micros(F.date_trunc("day", now)) + _clock_us())
    passed = (F.hour(now) > F.col("hour")) | ((F.hour(now) == F.col("hour")) & (F.minute(now) >= F.col("minute")))
    gone = (F.day(now) > F.col("day_of_month")) | ((F.day(now) == F.col("day_of_month")) & passed)
    month = F.date_trunc("month", now)
    month = F.when(gone, F.add_months(month, 1)).otherwise(month.cast("date"))
    by_month = F.timestamp_micros(F.unix_micros(F.date_add(month, F.col("day_of_month").cast("int") - 1).cast("timestamp"))
                                  + _clock_us())
    ahead = F.pmod(F.col("day_of_week") - F.weekday(now), F.lit(7))
    ahead = F.when((ahead == 0) & passed, 7).otherwise(ahead)
    by_week = F.timestamp_micros(F.unix_micros(today) + ahead.cast("bigint") * 86_400_000_000)
    by_interval = F.greatest(F.col("last_trained") + F.expr(f"interval {base_interval} days"), now)
    nxt = (F.when(~cal, by_interval).when(F.col("day_of_month").isNotNull(), by_month).when(F.col("day_of_week").isNotNull(), by_week).otherwise(today))
    return windows.select("model_id", due.alias("is_due"), nxt.alias("next_window"))


def schedule(windows: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Every calendar window of each model in (as_of, as_of + days]."""
    now = F.lit(as_of).cast("timestamp")
    end = now + F.expr(f"interval {days} days")
    d = windows.where(F.col("hour").isNotNull()).select("*", F.explode(F.sequence(F.to_date(now), F.to_date(end))).alias("__day"))
    at = F.timestamp_micros(F.unix_micros(F.col("__day").cast("timestamp")) + _clock_us())
    fits = F.when(F.col("day_of_month").isNotNull(), F.day("__day") == F.col("day_of_month")).when(
        F.col("day_of_week").isNotNull(), F.weekday("__day") == F.col("day_of_week")).otherwise(True)
    return d.withColumn("scheduled_at", at).where(fits & (F.col("scheduled_at") > now) & (F.col("scheduled_at") <= end)).select("model_id", "scheduled_at")


def adaptive_schedule(history: DataFrame, drift: DataFrame, runs: DataFrame, as_of: str, base: float = 30.0, low: float = 7.0, high: float = 60.0) -> DataFrame:
    """Next retraining of each model: its last interval times the drift and performance factors, clamped.

    history: model_id, scheduled_date, interval_days, updated_at; drift: model_id, ks_statistic of the
    newest report; runs: model_id, metric_name, value, previous."""
    last = latest(history, ["model_id"], "updated_at")
    mean = drift.groupBy("model_id").agg(F.avg("ks_statistic").alias("m"))
    drift_factor = F.when(F.col("m") > 0.5, 0.5).when(F.col("m") > 0.3, 0.75).when(F.col("m") < 0.1, 1.25).otherwise(1.0)
    change = F.when(F.col("metric_name").isin(HIGHER_BETTER), (F.col("previous") - F.col("value")) / 0.05).when(
        F.col("metric_name").isin(LOWER_BETTER) & (F.col("previous") > 0), (F.col("value") - F.col("previous")) / F.col("previous") / 0.15)
    worse = F.when(change > 0, F.least(change, F.lit(2.0)))
    perf = runs.groupBy("model_id").agg(F.avg(worse).alias("g"))
    perf_factor = F.when(F.col("g") > 1.5, 0.5).when(F.col("g") > 1.0, 0.75).when(F.col("g") > 0.5, 0.9).otherwise(1.0)
    j = last.join(mean, "model_id", "left").join(perf, "model_id", "left")
    j = j.withColumn("drift_factor", drift_factor).withColumn("performance_factor", perf_factor)
    days = F.least(F.greatest(F.col("interval_days") * F.col("drift_factor") * F.col("performance_factor"), F.lit(low)), F.lit(high))
    j = j.withColumn("next_interval", days)
    nxt = F.timestamp_micros((F.unix_micros("scheduled_date") + F.col("next_interval") * 86_400_000_000).cast("bigint"))
    return j.select("model_id", "drift_factor", "performance_factor", "next_interval", nxt.alias("next_date"),
                    (F.col("scheduled_date") <= F.lit(as_of).cast("timestamp")).alias("is_due"))


def verdict(drift: DataFrame, degradation: DataFrame, due: DataFrame, as_of: str) -> DataFrame:
    """One decision row per batch from the drift flags, degradation flags and due models."""
    d = drift.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("drift_detected"))
    g = degradation.agg(F.coalesce(F.bool_or("degraded"), F.lit(False)).alias("degradation_detected"))
    m = due.where("is_due").agg(F.count(F.lit(1)).alias("models_due"))
    one = with_row(with_row(d, g, "__g"), m, "__m").select("drift_detected", "__g.degradation_detected", "__m.models_due")
    trigger = F.col("drift_detected") | F.col("degradation_detected") | (F.col("models_due") > 0)
    reason = F.concat_ws("; ", F.when(F.col("drift_detected"), "data drift"), F.when(F.col("degradation_detected"), "performance degradation"),
                         F.when(F.col("models_due") > 0, "scheduled retraining"))
    return one.withColumn("retraining_triggered", trigger).withColumn("retraining_reason", F.when(trigger, reason)).withColumn(
        "timestamp", F.lit(as_of).cast("timestamp"))
