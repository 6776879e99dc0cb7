"""Queries of the window and time-series family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.operators import windows as op
from tidemark.registry.core import query
from tidemark.registry.features import H, TS, WD
from tidemark.registry.joins import interpolated

L = f"OVER (PARTITION BY location_id ORDER BY {TS}, event_id)"


@query("wn1_lags", ctes("obs") + "SELECT event_id, " + ", ".join(
    f"round(lag(occupancy, {k}) {L}, 6) AS occupancy_lag_{n}" for n, k in op.LAGS.items()) + " FROM obs")
def wn1(spark, root):
    o = fx.obs(spark, root).select("event_id", "location_id", "timestamp", "occupancy")
    return op.lags(o, ["location_id"], "timestamp", "occupancy", op.LAGS, ["event_id"]).drop("location_id", "timestamp", "occupancy")


@query("wn2_minute_lags", ctes("segments") + "SELECT event_id, " + ", ".join(
    f"lag(level, {m // 5}) OVER (PARTITION BY segment_id ORDER BY {TS}, event_id) AS level_lag_{m}" for m in (5, 10, 15)) + " FROM segments")
def wn2(spark, root):
    s = fx.segments(spark, root).select("event_id", "segment_id", "timestamp", "level")
    return op.minute_lags(s, ["segment_id"], "timestamp", "level", ties=["event_id"]).drop("segment_id", "timestamp", "level")


W3 = f"OVER (PARTITION BY location_id ORDER BY {TS}, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("wn3_trailing_rows", ctes("obs") + f"""SELECT event_id, CASE WHEN count(occupancy) {W3} = 3 THEN round(avg(occupancy) {W3}, 6) END AS occupancy_rolling_mean_3,
    CASE WHEN count(occupancy) {W3} = 3 THEN round(stddev_samp(occupancy) {W3}, 6) END AS occupancy_rolling_std_3 FROM obs""")
def wn3(spark, root):
    o = fx.obs(spark, root).select("event_id", "location_id", "timestamp", "occupancy")
    return op.trailing_rows(o, ["location_id"], "timestamp", "occupancy", 3, ["event_id"]).drop("location_id", "timestamp", "occupancy")


@query("wn4_previous_in_type_hour", ctes("segments") + f"""SELECT event_id, lag(level) OVER (PARTITION BY kind, {H} ORDER BY {TS}, event_id) AS level_lag_previous
    FROM segments""")
def wn4(spark, root):
    s = fx.segments(spark, root).select("event_id", "kind", F.hour("timestamp").alias("hour"), "timestamp", "level")
    return op.lags(s, ["kind", "hour"], "timestamp", "level", {"previous": 1}, ["event_id"]).select("event_id", "level_lag_previous")


GAPPY = "gappy AS (SELECT event_id, location_id, \"timestamp\", CASE WHEN event_id % 3 = 0 THEN occupancy END AS occupancy FROM obs)"


def gappy(spark, root):
    return fx.obs(spark, root).select("event_id", "location_id", "timestamp", F.when(F.col("event_id") % 3 == 0, F.col("occupancy")).alias("occupancy"))


PREV = f"last_value(occupancy IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY {TS}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
NEXT = f"first_value(occupancy IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY {TS}, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("wn5_fill", ctes("obs", extra=GAPPY) + f"""SELECT event_id, round(coalesce({PREV}, {NEXT}), 6) AS forward_back,
    round(coalesce({NEXT}, {PREV}), 6) AS back_forward FROM gappy""")
def wn5(spark, root):
    g = gappy(spark, root)
    a = op.fill(g, ["location_id"], "timestamp", ["occupancy"], ["event_id"]).select("event_id", F.col("occupancy").alias("forward_back"))
    b = op.fill(g, ["location_id"], "timestamp", ["occupancy"], ["event_id"], back_first=True).select("event_id", F.col("occupancy").alias("back_forward"))
    return a.join(b, "event_id")


@query("wn6_interpolate_time", ctes("obs", extra=GAPPY) + f"SELECT event_id, round({interpolated('occupancy')}, 6) AS occupancy FROM gappy")
def wn6(spark, root):
    return op.interpolate(gappy(spark, root), ["location_id"], "timestamp", ["occupancy"], ["event_id"]).select("event_id", "occupancy")


GRID7 = f"""e AS (SELECT location_id, min({TS}) AS lo, max({TS}) AS hi FROM obs_hourly GROUP BY 1),
    g AS (SELECT location_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS "timestamp" FROM e),
    f AS (SELECT g.location_id, g.{TS}, h.occupancy, h.parking_type FROM g LEFT JOIN obs_hourly h USING (location_id, {TS}))"""


@query("wn7_regular_grid", ctes("obs_hourly", extra=GRID7) + f"""SELECT location_id, {TS}, round({interpolated('occupancy', order=TS)}, 6) AS occupancy,
    last_value(parking_type IGNORE NULLS) OVER (PARTITION BY location_id ORDER BY {TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parking_type FROM f""")
def wn7(spark, root):
    h = fx.obs_hourly(spark, root).select("location_id", "timestamp", "occupancy", "parking_type")
    return op.regular_grid(h, "location_id", "timestamp", ["occupancy"], ["parking_type"])


@query("wn8_resample", ctes("weather", extra="""wh AS (SELECT date_trunc('hour', weather_time) AS t, avg(temperature) AS temperature, avg(humidity) AS humidity
    FROM weather GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(t) FROM wh), (SELECT max(t) FROM wh), INTERVAL 1 HOUR)) AS t)""") + """
    SELECT g.t AS weather_time, round(temperature, 6) AS temperature, round(humidity, 6) AS humidity FROM g LEFT JOIN wh ON wh.t = g.t""")
def wn8(spark, root):
    return op.resample(fx.weather(spark, root), "weather_time", ["temperature", "humidity"])


@query("wn9_smooth_anomalies", ctes("obs", extra=f"""z AS (SELECT event_id, location_id, {TS}, raw_value, abs((raw_value - avg(raw_value) OVER p)
    / stddev_samp(raw_value) OVER p) > 3 AS is_anomaly FROM obs WINDOW p AS (PARTITION BY location_id)),
    n AS (SELECT event_id, location_id, {TS}, is_anomaly, CASE WHEN NOT is_anomaly THEN raw_value END AS raw_value FROM z)""") + f"""
    SELECT event_id, is_anomaly, round({interpolated('raw_value')}, 6) AS raw_value FROM n""")
def wn9(spark, root):
    o = fx.obs(spark, root).select("event_id", "location_id", "timestamp", "raw_value")
    return op.smooth_anomalies(o, "location_id", "timestamp", "raw_value", ties=["event_id"]).select("event_id", "is_anomaly", "raw_value")


@query("wn10_flag_anomalies", ctes("obs") + f"""SELECT event_id, round(hz, 6) AS hour_z, abs(hz) > 3 AS hour_z_flag, round(lz, 6) AS location_z, abs(lz) > 3 AS location_z_flag
    FROM (SELECT event_id, (raw_value - avg(raw_value) OVER (PARTITION BY {H})) / greatest(stddev_samp(raw_value) OVER (PARTITION BY {H}), 1e-10) AS hz,
    (raw_value - avg(raw_value) OVER (PARTITION BY location_id)) / stddev_pop(raw_value) OVER (PARTITION BY location_id) AS lz FROM obs)""")
def wn10(spark, root):
    o = fx.obs(spark, root).select("event_id", "location_id", F.hour("timestamp").alias("hour"), "raw_value")
    a = op.flag_anomalies(o, ["hour"], "raw_value", population=False, out="hour_z")
    return op.flag_anomalies(a, ["location_id"], "raw_value", population=True, out="location_z").drop("location_id", "hour", "raw_value")


R24 = f"OVER (PARTITION BY metric_name ORDER BY {TS} RANGE BETWEEN INTERVAL '86399.999999' SECONDS PRECEDING AND CURRENT ROW)"
PCT = (0.25, 0.5, 0.75, 0.95)


@query("wn11_rolling_stats", ctes("metrics") + f"""SELECT event_id, round(CAST(avg(value) {R24} AS DECIMAL(18, 9)), 6)::DOUBLE AS mean, round(stddev_samp(value) {R24}, 6) AS std,
    round(min(value) {R24}, 6) AS min, round(max(value) {R24}, 6) AS max, count(value) {R24} AS count, round(skewness(value) {R24}, 6) AS skew,
    round(kurtosis(value) {R24}, 6) AS kurtosis, round(quantile_cont(value, 0.5) {R24}, 6) AS median, """ + ", ".join(
    f"round(quantile_cont(value, {p}) {R24}, 6) AS percentile_{round(p * 100)}" for p in PCT) + " FROM metrics")
def wn11(spark, root):
    m = fx.metrics(spark, root).select("event_id", "metric_name", "timestamp", "value")
    out = op.rolling_stats(m, ["metric_name"], "timestamp", "value").drop("metric_name", "timestamp", "value")
    # means of two-digit values over 32 or 64 rows end in a five: decimals round them alike
    return out.withColumn("mean", F.round(F.col("mean").cast("decimal(18, 9)"), 6).cast("double"))


EW = f"OVER (PARTITION BY metric_name ORDER BY {TS}, event_id ROWS BETWEEN 399 PRECEDING AND CURRENT ROW)"


@query("wn12_ewm", ctes("metrics", extra=f"""o AS (SELECT event_id, metric_name, row_number() OVER (PARTITION BY metric_name ORDER BY {TS}, event_id) AS i,
    value FROM metrics), l AS (SELECT event_id, list(value) OVER w AS h FROM o WINDOW w AS (PARTITION BY metric_name ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW)),
    x AS (SELECT event_id, h, list_transform(range(len(h)), lambda j: pow(0.9::DOUBLE, len(h) - 1 - j)) AS g FROM l),
    y AS (SELECT event_id, h, g, list_dot_product(g, h) / list_sum(g) AS m FROM x)""") + """SELECT event_id, round(m, 6) AS ewm_mean,
    CASE WHEN len(h) > 1 THEN round(sqrt(list_dot_product(g, list_transform(h, lambda v: (v - m) * (v - m))) / list_sum(g)
    / (1 - list_dot_product(g, g) / (list_sum(g) * list_sum(g)))), 6) END AS ewm_std FROM y""")
def wn12(spark, root):
    m = fx.metrics(spark, root).select("event_id", "metric_name", "timestamp", "value")
    return op.ewm(m, ["metric_name"], "timestamp", "value", ties=["event_id"]).select("event_id", "ewm_mean", "ewm_std")


@query("wn13_rolling_trend", ctes("metrics", extra=f"""o AS (SELECT event_id, metric_name, {TS}, value, row_number() OVER (PARTITION BY metric_name
    ORDER BY {TS}, event_id) AS i FROM metrics)""") + f"""SELECT event_id, CASE WHEN count(*) {R24} >= 2 THEN round(corr(value, i) {R24}, 6) END AS trend_correlation FROM o""")
def wn13(spark, root):
    m = fx.metrics(spark, root).select("event_id", "metric_name", "timestamp", "value")
    return op.rolling_trend(m, ["metric_name"], "timestamp", "value", ties=["event_id"]).select("event_id", "trend_correlation")


@query("wn14_rate_of_change", ctes("metrics") + f"""SELECT event_id, CASE WHEN count(*) {R24} >= 2 THEN round((value - first_value(value) {R24}) / 24, 6) END AS rate_of_change
    FROM metrics""")
def wn14(spark, root):
    m = fx.metrics(spark, root).select("event_id", "metric_name", "timestamp", "value")
    return op.rate_of_change(m, ["metric_name"], "timestamp", "value").select("event_id", "rate_of_change")


@query("wn15_volatility", ctes("metrics", extra=f"""r AS (SELECT event_id, metric_name, {TS}, value / nullif(lag(value) OVER (PARTITION BY metric_name ORDER BY {TS}, event_id), 0) - 1 AS ret
    FROM metrics)""") + f"SELECT event_id, CASE WHEN count(ret) {R24} >= 2 THEN round(stddev_samp(ret) {R24}, 4) END AS volatility FROM r", digits=4)
def wn15(spark, root):
    m = fx.metrics(spark, root).select("event_id", "metric_name", "timestamp", "value")
    return op.volatility(m, ["metric_name"], "timestamp", "value", ties=["event_id"]).select("event_id", "volatility")


@query("wn16_performance_trend", ctes("metrics", extra=f"""d AS (SELECT model_id, date_trunc('day', {TS}) AS period, avg(value) AS value, count(value) AS sample_size
    FROM metrics GROUP BY 1, 2), r AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS rolling_mean,
    CASE WHEN count(*) OVER w = 7 THEN stddev_samp(value) OVER w END AS rolling_std FROM d
    WINDOW w AS (PARTITION BY model_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""") + """SELECT model_id, period, round(value, 6) AS value, sample_size,
    round(rolling_mean, 6) AS rolling_mean, round(rolling_std, 6) AS rolling_std,
    round(coalesce(rolling_mean - lag(rolling_mean) OVER (PARTITION BY model_id ORDER BY period), 0), 6) + 0.0 AS trend FROM r""")
def wn16(spark, root):
    return op.performance_trend(fx.metrics(spark, root), ["model_id"], "timestamp", "value")


@query("wn17_slot_smoothing", ctes("segments", extra=f"p AS (SELECT {H} * 12 + minute({TS}) // 5 AS time_slot, avg(level) AS mean, count(level) AS count FROM segments GROUP BY 1)")
       + """SELECT time_slot, round(mean, 6) AS mean, count, CASE WHEN count(*) OVER w = 12 THEN round(avg(mean) OVER w, 6) END AS smoothed FROM p
    WINDOW w AS (ORDER BY time_slot ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""")
def wn17(spark, root):
    from tidemark.functions.calendar import slot_of_day

    s = fx.segments(spark, root).withColumn("time_slot", slot_of_day(F.col("timestamp")))
    return op.slot_smoothing(s, "time_slot", "level")


CH = f"ch AS (SELECT event_id, level, lag(level) OVER (PARTITION BY segment_id ORDER BY {TS}, event_id) AS previous FROM segments)"


@query("wn18_value_changes", ctes("segments", extra=CH) + """SELECT event_id, previous, level - previous AS change, coalesce(level <> previous, TRUE) AS changed FROM ch""")
def wn18(spark, root):
    s = fx.segments(spark, root).select("event_id", "segment_id", "timestamp", "level")
    return op.value_changes(s, ["segment_id"], "timestamp", "level", ["event_id"]).select("event_id", "previous", "change", "changed")


@query("wn18_transitions", ctes("segments", extra=CH) + "SELECT previous, level, count(*) AS count FROM ch WHERE previous IS NOT NULL GROUP BY 1, 2")
def wn18b(spark, root):
    s = fx.segments(spark, root).select("event_id", "segment_id", "timestamp", "level")
    return op.transitions(op.value_changes(s, ["segment_id"], "timestamp", "level", ["event_id"]), "level")


@query("wn19_moving_average", ctes("obs") + f"""SELECT event_id, round(sum(occupancy) OVER (PARTITION BY location_id ORDER BY {TS}, event_id
    ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smoothed FROM obs""")
def wn19(spark, root):
    o = fx.obs(spark, root).select("event_id", "location_id", "timestamp", "occupancy")
    return op.moving_average(o, ["location_id"], "timestamp", "occupancy", 3, ["event_id"]).select("event_id", "smoothed")


@query("wn20_latest", ctes("metrics") + f"""SELECT model_id, metric_name, value, {TS}, event_id FROM metrics
    QUALIFY row_number() OVER (PARTITION BY model_id, metric_name ORDER BY {TS} DESC, event_id DESC) = 1""")
def wn20(spark, root):
    return op.latest(fx.metrics(spark, root), ["model_id", "metric_name"], "timestamp", ["event_id"])


PV = f"pv AS (SELECT *, lag(value) OVER (PARTITION BY model_id, metric_name ORDER BY {TS}, event_id) AS previous FROM scored_metrics)"


@query("wn21_degradation", ctes("scored_metrics", extra=PV) + """, d AS (SELECT event_id, metric_name, previous, CASE WHEN metric_name = 'r2' THEN previous - value
    WHEN metric_name IN ('rmse', 'mae') THEN (value - previous) / nullif(previous, 0) END AS x FROM pv)
    SELECT event_id, round(previous, 6) AS previous, round(x, 6) + 0.0 AS deterioration,
    coalesce(x > CASE WHEN metric_name = 'r2' THEN 0.05 ELSE 0.1 END, FALSE) AS degraded FROM d""")
def wn21(spark, root):
    return op.degradation(fx.scored_metrics(spark, root), ["model_id"], "timestamp", "metric_name", "value", ["event_id"]).select(
        "event_id", "previous", "deterioration", "degraded")


DW = f"""dd AS (SELECT d, (row_number() OVER (ORDER BY d) - 1) // 7 AS window_idx, count(*) OVER () AS n FROM (SELECT DISTINCT CAST({TS} AS DATE) AS d FROM obs)),
    dw AS (SELECT d, window_idx, min(d) OVER (PARTITION BY window_idx) AS window_start, max(d) OVER (PARTITION BY window_idx) AS window_end FROM dd WHERE (window_idx + 1) * 7 <= n)"""


@query("wn22_complete_windows", ctes("obs", extra=DW) + f"""SELECT o.event_id, window_idx, window_start, window_end FROM obs o JOIN dw ON CAST(o.{TS} AS DATE) = dw.d""")
def wn22(spark, root):
    return op.complete_windows(fx.obs(spark, root).select("event_id", "timestamp"), "timestamp").drop("timestamp")


@query("wn23_trend_slopes", ctes("metrics") + f""", d AS (SELECT model_id AS model, CAST({TS} AS DATE) AS window_idx, avg(value) AS rmse, -avg(value) / 10 AS r2 FROM metrics GROUP BY 1, 2),
    i AS (SELECT *, (row_number() OVER (PARTITION BY model ORDER BY window_idx) - 1)::DOUBLE AS x FROM d), s AS (SELECT model, count(*) AS points,
    regr_slope(rmse, x) AS a, regr_slope(r2, x) AS b FROM i GROUP BY 1) SELECT model, points, round(a, 6) AS rmse_slope, round(b, 6) AS r2_slope,
    a > 0.1 OR b < -0.05 AS degrading FROM s WHERE points >= 3""")
def wn23(spark, root):
    d = fx.metrics(spark, root).groupBy(F.col("model_id").alias("model"), F.to_date("timestamp").alias("window_idx")).agg(
        F.avg("value").alias("rmse"), (-F.avg("value") / 10).alias("r2"))
    return op.degradation_trends(d)


@query("wn24_sequences", ctes("obs") + f"""SELECT event_id, round(target, 6) AS target, round(list_sum(h), 4) AS history_sum, round(h[1], 6) AS oldest, round(h[24], 6) AS newest,
    round(list_sum(hk), 4) AS k_sum FROM (SELECT event_id, occupancy AS target, list(occupancy) OVER w AS h, list(k::DOUBLE) OVER w AS hk FROM obs
    WINDOW w AS (PARTITION BY location_id ORDER BY {TS}, event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) WHERE len(h) = 24""")
def wn24(spark, root):
    o = fx.obs(spark, root).select("event_id", "location_id", "timestamp", "occupancy", F.col("k").cast("double").alias("k"))
    s = op.sequences(o, ["location_id"], "timestamp", ["occupancy", "k"], "occupancy", 24, ["event_id"])
    total = F.aggregate("history", F.lit(0.0), lambda a, x: a + x["occupancy"])
    ktotal = F.aggregate("history", F.lit(0.0), lambda a, x: a + x["k"])
    return s.select("event_id", "target", F.round(total, 4).alias("history_sum"), F.col("history")[0]["occupancy"].alias("oldest"),
                    F.col("history")[23]["occupancy"].alias("newest"), F.round(ktotal, 4).alias("k_sum"))


@query("wn25_newest_per_log", ctes("op_log") + f"""SELECT operation, event_id FROM op_log QUALIFY row_number() OVER (PARTITION BY operation ORDER BY {TS} DESC, event_id DESC) <= 1000""")
def wn25(spark, root):
    return op.newest(fx.op_log(spark, root).select("operation", "event_id", "timestamp"), ["operation"], "timestamp", ["event_id"], 1000).drop("timestamp")


R5 = f"OVER (PARTITION BY model_id ORDER BY {TS} RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)"


@query("wn26_recent_error_rate", ctes("op_log") + f"""SELECT event_id, count(*) {R5} AS request_count, round(avg(is_error::INT) {R5}, 6) AS recent_error_rate FROM op_log""")
def wn26(spark, root):
    o = fx.op_log(spark, root).select("event_id", "model_id", "timestamp", "is_error")
    return op.recent_error_rate(o, "model_id", "timestamp", "is_error").drop("model_id", "timestamp", "is_error")


@query("wn27_metric_change", ctes("scored_metrics", extra=PV) + """SELECT event_id, round((value - previous) / nullif(abs(previous), 0) * 100, 6) + 0.0 AS change_pct,
    CASE WHEN metric_name = 'r2' THEN value > previous ELSE value < previous END AS is_improvement FROM pv""")
def wn27(spark, root):
    return op.metric_change(fx.scored_metrics(spark, root), ["model_id"], "timestamp", "metric_name", "value", ["event_id"]).select(
        "event_id", "change_pct", "is_improvement")
