"""Queries of the aggregation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.functions import calendar
from tidemark.operators import aggs as op
from tidemark.operators import joins
from tidemark.registry.core import query
from tidemark.registry.features import H, WD, WE, TS

MS = "round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std"


@query("flagship_hourly_profile", ctes("obs", "weather", extra="""wh AS (SELECT date_trunc('hour', weather_time) AS h,
    avg(temperature) AS temperature FROM weather GROUP BY 1)""") + f"""SELECT hour({TS}) AS hour, {WE} AS is_weekend,
    CASE WHEN {H} < 6 THEN 'night' WHEN {H} < 12 THEN 'morning' WHEN {H} < 18 THEN 'afternoon' ELSE 'evening' END AS time_category,
    {MS.format('occupancy')}, count(occupancy) AS count, round(avg(temperature), 6) AS mean_temperature
    FROM obs LEFT JOIN wh ON date_trunc('hour', {TS}) = wh.h GROUP BY 1, 2, 3""")
def flagship(spark, root):
    o = joins.join_weather_hour(fx.obs(spark, root), joins.weather_hourly(fx.weather(spark, root)), fill=False)
    ts = F.col("timestamp")
    o = o.withColumns({"hour": F.hour(ts), "is_weekend": calendar.is_weekend(ts), "time_category": calendar.time_category(F.hour(ts))})
    return o.groupBy("hour", "is_weekend", "time_category").agg(
        F.avg("occupancy").alias("mean"), F.stddev_samp("occupancy").alias("std"), F.count("occupancy").alias("count"),
        F.avg("temperature").alias("mean_temperature"))


@query("ag1_hourly_stats", ctes("obs") + f"""SELECT {H} AS hour, round(avg(occupancy), 2) AS mean, round(stddev_samp(occupancy), 2) AS std,
    count(occupancy) AS count FROM obs GROUP BY 1""", digits=2)
def ag1(spark, root):
    return op.mean_std(fx.obs(spark, root).withColumn("hour", F.hour("timestamp")), ["hour"], "occupancy")


def _names(names):
    return ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))


@query("ag2_day_profile", ctes("obs") + f"""SELECT CAST(d.position AS BIGINT) AS position, d.day_name, mean, std FROM
    (VALUES {_names(op.DAY_NAMES)}) d(position, day_name) LEFT JOIN (SELECT dayname({TS}) AS day_name, {MS.format('occupancy')}
    FROM obs GROUP BY 1) g USING (day_name)""")
def ag2(spark, root):
    return op.named_profile(fx.obs(spark, root), "timestamp", "occupancy", "day")


@query("ag3_month_profile", ctes("obs") + f"""SELECT CAST(d.position AS BIGINT) AS position, d.month_name, mean, std FROM
    (VALUES {_names(op.MONTH_NAMES)}) d(position, month_name) LEFT JOIN (SELECT monthname({TS}) AS month_name, {MS.format('occupancy')}
    FROM obs GROUP BY 1) g USING (month_name)""")
def ag3(spark, root):
    return op.named_profile(fx.obs(spark, root), "timestamp", "occupancy", "month")


@query("ag4_weekend_profile", ctes("obs") + f"SELECT {WE} AS is_weekend, {MS.format('occupancy')} FROM obs GROUP BY 1")
def ag4(spark, root):
    o = fx.obs(spark, root).withColumn("is_weekend", calendar.is_weekend(F.col("timestamp")))
    return op.mean_std(o, ["is_weekend"], "occupancy", count=False)


@query("ag5_location_stats", ctes("obs") + """SELECT location_id, round(avg(occupancy), 6) AS avg_occupancy,
    round(stddev_samp(occupancy), 6) AS std_occupancy, round(min(occupancy), 6) AS min_occupancy, round(max(occupancy), 6) AS max_occupancy,
    arg_min(capacity + event_id % 3, "timestamp") AS capacity FROM obs GROUP BY 1""")
def ag5(spark, root):
    o = fx.obs(spark, root).withColumn("capacity", F.col("capacity") + F.col("event_id") % 3)
    return op.location_stats(o, ties=["event_id"])


@query("ag6_location_zone_stats", ctes("obs") + f"SELECT location_id, parking_type, {MS.format('occupancy')} FROM obs GROUP BY 1, 2")
def ag6(spark, root):
    return op.mean_std(fx.obs(spark, root), ["location_id", "parking_type"], "occupancy", count=False)


def _describe(col):
    return f"""SELECT '{col}' AS column_name, count({col}) AS count, round(avg({col}), 6) AS mean, round(stddev_samp({col}), 6) AS std,
        round(min({col}), 6) AS min, round(quantile_cont({col}, 0.25), 6) AS q25, round(quantile_cont({col}, 0.5), 6) AS q50,
        round(quantile_cont({col}, 0.75), 6) AS q75, round(max({col}), 6) AS max FROM features"""


@query("ag7_describe", ctes("features") + " UNION ALL ".join(_describe(c) for c in ("value", "k", '"load"')).replace("'\"load\"'", "'load'"))
def ag7(spark, root):
    return op.describe(fx.features(spark, root), ["value", "k", "load"])


@query("ag8_missing_profile", ctes("raw_dirty") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 6)::DOUBLE AS missing_pct FROM raw_dirty"
    for c in ("total_spots", "occupancy_rate", "location_id", "is_holiday")))
def ag8(spark, root):
    return op.missing_profile(fx.raw_dirty(spark, root), ["total_spots", "occupancy_rate", "location_id", "is_holiday"])


@query("ag9_value_counts", ctes("raw_dirty") + """SELECT model_version, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share
    FROM raw_dirty WHERE model_version IS NOT NULL GROUP BY 1""")
def ag9(spark, root):
    return op.value_counts(fx.raw_dirty(spark, root), "model_version")


@query("ag10_summary_report", ctes("obs") + f"""SELECT item, round(amount, 4) AS amount FROM (
    SELECT 'observations' AS item, count(*)::DOUBLE AS amount FROM obs
    UNION ALL SELECT 'locations', count(DISTINCT location_id) FROM obs UNION ALL SELECT 'average', avg(occupancy) FROM obs
    UNION ALL SELECT 'lowest', min(occupancy) FROM obs UNION ALL SELECT 'highest', max(occupancy) FROM obs
    UNION ALL SELECT 'first_us', epoch_us(min({TS})) FROM obs UNION ALL SELECT 'last_us', epoch_us(max({TS})) FROM obs
    UNION ALL SELECT 'missing', count(*) - count(occupancy) FROM obs
    UNION ALL SELECT 'parking_type: ' || parking_type, count(*) FROM obs GROUP BY parking_type)""", digits=4)
def ag10(spark, root):
    return op.summary(fx.obs(spark, root), "timestamp", "location_id", "occupancy", ["parking_type"], ["occupancy", "capacity"])


@query("ag11_week_profile", ctes("obs") + f""", g AS (SELECT location_id, {WD} * 24 + {H} AS dh, avg(occupancy) AS m FROM obs GROUP BY 1, 2),
    big AS (SELECT location_id FROM obs GROUP BY 1 HAVING count(*) > 168)
    SELECT big.location_id, x.dh // 24 AS weekday, x.dh % 24 AS hour, round(coalesce(g.m, 0), 6) AS mean
    FROM big CROSS JOIN (SELECT unnest(range(0, 168)) AS dh) x LEFT JOIN g ON g.location_id = big.location_id AND g.dh = x.dh""")
def ag11(spark, root):
    return op.week_profile(fx.obs(spark, root), "timestamp", "occupancy", "location_id")


@query("ag12_pivot_hour_weekday", ctes("obs") + f"SELECT {H} AS hour, " + ", ".join(
    f"round(avg(occupancy) FILTER ({WD} = {d}), 6) AS mean_{d}, count(occupancy) FILTER ({WD} = {d}) AS count_{d}" for d in range(7))
    + ", " + ", ".join(f"round(avg(occupancy) FILTER (parking_type = '{k}'), 6) AS \"mean_{k}\"" for k in ("Mixed", "Public", "Resident"))
    + " FROM obs GROUP BY 1")
def ag12(spark, root):
    o = fx.obs(spark, root).withColumns({"hour": F.hour("timestamp"), "weekday": F.weekday("timestamp")})
    mean = op.pivot(o, ["hour"], "weekday", range(7), "occupancy", "avg", "mean")
    count = op.pivot(o, ["hour"], "weekday", range(7), "occupancy", "count", "count")
    kinds = op.pivot(o, ["hour"], "parking_type", ["Mixed", "Public", "Resident"], "occupancy", "avg", "mean")
    return mean.join(count.fillna(0), "hour").join(kinds, "hour")


@query("ag13_crosstab", ctes("segments") + "SELECT kind, " + ", ".join(
    f"round(count(*) FILTER (level = {v}) / count(*), 6)::DOUBLE AS n_{v}" for v in range(4)) + " FROM segments GROUP BY 1")
def ag13(spark, root):
    return op.crosstab(fx.segments(spark, root), "kind", "level", range(4), normalize=True)


def _band(c, edges, labels):
    return "CASE " + " ".join(f"WHEN {c} > {lo} AND {c} <= {hi} THEN '{n}'" for lo, hi, n in zip(edges, edges[1:], labels)) + " END"


@query("ag14_fixed_bins", ctes("obs") + f"""SELECT {_band('occupancy / 100', *op.SHARE_BANDS)} AS band, {_band(H, *op.TIME_BLOCKS)} AS time_block,
    count(*) AS count FROM obs GROUP BY 1, 2""")
def ag14(spark, root):
    band = op.cut_labels(F.col("occupancy") / 100, *op.SHARE_BANDS)
    return fx.obs(spark, root).groupBy(band.alias("band"), op.cut_labels(F.hour("timestamp"), *op.TIME_BLOCKS).alias("time_block")).agg(
        F.count(F.lit(1)).alias("count"))


@query("ag15_decile_bins", ctes("features") + """, e AS (SELECT list_sort(list_distinct(quantile_cont(k, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6,
    0.7, 0.8, 0.9, 1.0]))) AS edges FROM features),
    b AS (SELECT value, greatest(len(list_filter(edges, lambda x: x < k)) - 1, 0) AS bin, edges FROM features, e)
    SELECT bin, round(any_value(edges[bin + 1]), 6) AS bin_left, round(any_value(edges[bin + 2]), 6) AS bin_right,
    round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS count FROM b GROUP BY bin""")
def ag15(spark, root):
    b = op.quantile_bins(fx.features(spark, root), "k", 10)
    return b.groupBy("bin", "bin_left", "bin_right").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                                         F.count("value").alias("count"))


def width_bin_sql(col, lo, hi, bins=10):
    return " + ".join(f"CASE WHEN {col} > {lo} + ({hi} - {lo}) / {bins} * {j} THEN 1 ELSE 0 END" for j in range(1, bins))


@query("ag16_width_bins", ctes("features") + f"""SELECT CAST({width_bin_sql('value', 'lo', 'hi')} AS BIGINT) AS bin,
    {MS.format('k')}, count(k) AS count FROM features, (SELECT min(value) AS lo, max(value) AS hi FROM features) GROUP BY 1""")
def ag16(spark, root):
    return op.bin_stats(op.width_bins(fx.features(spark, root), "value"), "k")


@query("ag17_utilization", ctes("segments") + f"""SELECT kind, CASE WHEN {H} >= 8 AND {H} < 20 THEN 1 ELSE 0 END::BIGINT AS regulated_hours,
    {MS.format('level')}, count(level) AS count, round(avg((level > 0)::INT), 6) AS utilization_rate FROM segments GROUP BY 1, 2""")
def ag17(spark, root):
    s = fx.segments(spark, root).withColumn("regulated_hours", calendar.regulated(F.hour("timestamp")))
    return op.utilization(s, ["kind", "regulated_hours"], "level")


@query("ag18_peak_hours", ctes("segments") + f""", h AS (SELECT kind, {H} AS hour, avg(level) AS m FROM segments GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY m DESC, hour) AS rn FROM h)
    SELECT p.kind, p.hour AS peak_hour, round(p.m, 6) AS peak_level, round(g.mean_level, 6) AS mean_level,
    round(g.utilization_pct, 6) AS utilization_pct FROM p JOIN (SELECT kind, avg(level) AS mean_level,
    avg((level > 0)::INT) * 100 AS utilization_pct FROM segments GROUP BY 1) g ON g.kind = p.kind WHERE rn = 1""")
def ag18(spark, root):
    return op.peak_hours(fx.segments(spark, root), "kind", "timestamp", "level")


@query("ag19_count_map", ctes("segments") + "SELECT kind, level, count(*) AS count FROM segments GROUP BY 1, 2")
def ag19(spark, root):
    return op.count_map(fx.segments(spark, root), "kind", "level").select("kind", F.explode("counts").alias("level", "count"))


@query("ag20_distinct_per_group", ctes("segments") + """SELECT kind, array_to_string(list_sort(list(DISTINCT tariff)), ';') AS tariffs
    FROM segments GROUP BY 1""")
def ag20(spark, root):
    return op.distinct_per_group(fx.segments(spark, root), "kind", "tariff").select("kind", F.array_join("values", ";").alias("tariffs"))


@query("ag21_table_stats", ctes("obs") + """SELECT count(*) AS total_records, count(DISTINCT location_id) AS unique_locations,
    array_to_string(list_sort(list(DISTINCT location_id)), ',') AS locations, min("timestamp") AS first_time, max("timestamp") AS last_time
    FROM obs""")
def ag21(spark, root):
    return op.table_stats(fx.obs(spark, root), "location_id", "timestamp")


@query("ag22_business_impact", ctes("predictions") + """SELECT location_id, round(avg(actual * 3), 6) AS avg_revenue,
    round(avg(abs(actual - predicted)), 6) AS avg_opportunity_cost, round(avg(1 - abs(actual - predicted) / actual), 6) AS avg_accuracy
    FROM predictions GROUP BY 1""")
def ag22(spark, root):
    p = fx.predictions(spark, root)
    lm = p.select("location_id", (F.col("actual") * 3).alias("revenue"), F.abs(F.col("actual") - F.col("predicted")).alias("opportunity_cost"),
                  (1 - F.abs(F.col("actual") - F.col("predicted")) / F.col("actual")).alias("occupancy_accuracy"))
    return spark.sql("""SELECT location_id, AVG(revenue) AS avg_revenue, AVG(opportunity_cost) AS avg_opportunity_cost,
        AVG(occupancy_accuracy) AS avg_accuracy FROM {lm} GROUP BY location_id ORDER BY avg_revenue DESC""", lm=lm)


@query("ag23_drift_history", ctes("features") + """SELECT category AS feature, count(*) FILTER (value > 100) AS drift_count,
    round(avg(k / 100), 6) AS avg_p_value, round(max(value), 6) AS max_statistic FROM features GROUP BY 1""")
def ag23(spark, root):
    f = fx.features(spark, root).select(F.col("category").alias("feature"), (F.col("value") > 100).alias("drift_detected"),
                                        (F.col("k") / 100).alias("p_value"), F.col("value").alias("statistic"))
    return op.drift_history(f)


@query("ag24_action_statistics", ctes("features") + f""", a AS (SELECT category AS action_type, CAST(event_id % 3 + 1 AS VARCHAR) AS priority,
    0.7 + k / 400 AS confidence, epoch_us({TS}) AS us FROM features), s AS (SELECT min(us) AS lo, max(us) AS hi FROM a),
    t AS (SELECT *, CAST(CAST(least(floor((us - lo) / ((hi - lo) / 20.0::DOUBLE)), 19) AS BIGINT) AS VARCHAR) AS tb FROM a, s)
    SELECT section, item, count(*) AS count, round(avg(confidence), 6) AS mean_confidence FROM (
    SELECT 'type' AS section, action_type AS item, confidence FROM t UNION ALL SELECT 'priority', priority, confidence FROM t
    UNION ALL SELECT 'time', tb, confidence FROM t) GROUP BY 1, 2""")
def ag24(spark, root):
    a = fx.features(spark, root).select(F.col("category").alias("action_type"), (F.col("event_id") % 3 + 1).alias("priority"),
                                        (F.lit(0.7) + F.col("k") / 400).alias("confidence"), "timestamp")
    return op.action_statistics(a)


@query("ag25_operation_rollup", ctes("op_log") + """SELECT operation, count(*) AS query_count, count(*) FILTER (is_error) AS error_count,
    round(sum(duration_ms), 4) AS total_ms, arg_max(event_id, "timestamp") FILTER (is_error) AS last_error_id FROM op_log GROUP BY 1""", digits=4)
def ag25(spark, root):
    return op.operation_rollup(fx.op_log(spark, root))


@query("ag26_latency_percentiles", ctes("op_log") + """SELECT operation, round(avg(duration_ms), 6) AS mean,
    round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99 FROM op_log GROUP BY 1""")
def ag26(spark, root):
    return op.latency_stats(fx.op_log(spark, root), "duration_ms", ["operation"])


@query("ag26_latency_percentiles_approx")
def ag26_approx(spark, root):
    return op.latency_stats_approx(fx.op_log(spark, root), "duration_ms", ["operation"])


@query("ag27_latency_nearest_rank", ctes("op_log") + """, s AS (SELECT operation, duration_ms, row_number() OVER (PARTITION BY operation
    ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY operation) AS n FROM op_log)
    SELECT operation, any_value(n) AS n, max(duration_ms) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95,
    max(duration_ms) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99 FROM s GROUP BY 1""")
def ag27(spark, root):
    return op.latency_rank_stats(fx.op_log(spark, root), "duration_ms", ["operation"])


@query("ag28_availability", ctes("health") + """SELECT component, n AS data_points, healthy, degraded, critical,
    round(a, 6) AS availability, CASE WHEN a > 0.98 THEN 'healthy' WHEN a > 0.9 THEN 'degraded' ELSE 'critical' END AS overall_status
    FROM (SELECT component, count(*) AS n, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'degraded') AS degraded,
    count(*) FILTER (status = 'critical') AS critical, count(*) FILTER (status IN ('healthy', 'degraded')) / count(*)::DOUBLE AS a
    FROM health GROUP BY 1)""")
def ag28(spark, root):
    return op.availability(fx.health(spark, root), keys=["component"])


@query("ag29_response_times", ctes("health") + """SELECT endpoint, round(avg(ms), 6) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM (
    SELECT 'predict' AS endpoint, CASE WHEN error_rate > 0 THEN 0.0 ELSE latency_ms END AS ms FROM health
    UNION ALL SELECT 'status', cpu_percent FROM health) WHERE ms > 0 GROUP BY 1""")
def ag29(spark, root):
    times = F.create_map(F.lit("predict"), F.when(F.col("error_rate") > 0, 0.0).otherwise(F.col("latency_ms")),
                         F.lit("status"), F.col("cpu_percent"))
    return op.response_times(fx.health(spark, root).select(times.alias("times")), "times")


def _hist(c):
    return f"""SELECT '{c}' AS column_name, side, CAST(coalesce(least(floor((v - lo) * 30 / (hi - lo)), 29), 0) AS BIGINT) AS bin, n FROM
    (SELECT side, {c} AS v, count(*) OVER (PARTITION BY side) AS n, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM
    (SELECT 'reference' AS side, {c} FROM reference UNION ALL SELECT 'current', {c} FROM current))"""


@query("ag30_histograms", ctes("reference", "current").replace("WITH", "WITH", 1) + f"""SELECT column_name, side, bin,
    round(count(*) / any_value(n)::DOUBLE, 6) AS share FROM ({_hist('value')} UNION ALL {_hist('k')}) GROUP BY 1, 2, 3""".replace(
    "FROM current)", 'FROM "current")'))
def ag30(spark, root):
    return op.histograms(fx.reference(spark, root), fx.current(spark, root), ["value", "k"])


@query("ag31_missing_over_time", ctes("raw_dirty") + """, t AS (SELECT *, date_trunc('month', TRY_CAST("timestamp" AS TIMESTAMP)) AS bucket
    FROM raw_dirty) SELECT bucket, feature, round(rate, 6) AS missing_rate FROM (
    SELECT bucket, 'total_spots' AS feature, avg((total_spots IS NULL)::INT) AS rate FROM t GROUP BY 1
    UNION ALL SELECT bucket, 'occupancy_rate', avg((occupancy_rate IS NULL)::INT) FROM t GROUP BY 1)""")
def ag31(spark, root):
    r = fx.raw_dirty(spark, root).withColumn("at", F.try_to_timestamp("timestamp"))
    return op.missing_over_time(r, "at", ["total_spots", "occupancy_rate"], "month")


@query("ag32_importance_by_group", """WITH f AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'Hour_' WHEN 1 THEN 'temperature_' WHEN 2 THEN 'capacity_'
    WHEN 3 THEN 'traffic_level_' WHEN 4 THEN 'other_' ELSE 'Month_' END || p_partkey AS feature, p_retailprice / 1000 AS importance FROM part)
    SELECT category, round(sum(importance), 4) AS importance FROM (SELECT importance, CASE
    WHEN lower(feature) LIKE '%hour%' OR lower(feature) LIKE '%month%' THEN 'time' WHEN lower(feature) LIKE '%temperature%' THEN 'weather'
    WHEN lower(feature) LIKE '%capacity%' THEN 'location' WHEN lower(feature) LIKE '%traffic_level%' THEN 'traffic' END AS category FROM f)
    WHERE category IS NOT NULL GROUP BY 1""", digits=4)
def ag32(spark, root):
    n = F.col("p_partkey") % 6
    name = F.when(n == 0, "Hour_").when(n == 1, "temperature_").when(n == 2, "capacity_").when(n == 3, "traffic_level_").when(n == 4, "other_").otherwise("Month_")
    p = fx.read_table(spark, root, "part").select(F.concat(name, F.col("p_partkey").cast("string")).alias("feature"),
                                                  (F.col("p_retailprice") / 1000).alias("importance"))
    return op.importance_by_group(p)


@query("ag33_error_profile", ctes("predictions") + f""", p AS (SELECT *, abs(actual - predicted) AS e, min(actual) OVER () AS lo,
    max(actual) OVER () AS hi FROM predictions)
    SELECT facet, item, round(avg(e), 6) AS mean_error, round(stddev_samp(e), 6) AS std_error, count(e) AS count FROM (
    SELECT 'hour' AS facet, CAST({H} AS VARCHAR) AS item, e FROM p UNION ALL SELECT 'weekday', CAST({WD} AS VARCHAR), e FROM p
    UNION ALL SELECT 'weekend', CAST({WE} AS VARCHAR), e FROM p UNION ALL SELECT 'location', location_id, e FROM p
    UNION ALL SELECT 'level', CAST({width_bin_sql('actual', 'lo', 'hi')} AS VARCHAR), e FROM p) GROUP BY 1, 2""")
def ag33(spark, root):
    return op.error_profile(fx.predictions(spark, root))


@query("ag34_zero_profile", ctes("segments") + f"""SELECT {H} AS hour, {H} BETWEEN 7 AND 18 AS is_operational, count(*) FILTER (level = 0) AS zero,
    count(*) FILTER (level <> 0) AS non_zero, count(*) FILTER (level <> 0 AND NOT {H} BETWEEN 7 AND 18) AS non_zero_outside
    FROM segments GROUP BY 1, 2""")
def ag34(spark, root):
    return op.zero_profile(fx.segments(spark, root), "timestamp", "level")


@query("ag35_boundary_profile", ctes("segments") + f"SELECT {H} * 60 + minute({TS}) AS minute_of_day, " + ", ".join(
    f"count(*) FILTER (level = {v}) AS level_{v}" for v in range(4)) + f", round(avg(level), 6) AS mean_level FROM segments WHERE {H} IN (6, 7, 18, 19) GROUP BY 1")
def ag35(spark, root):
    return op.boundary_profile(fx.segments(spark, root), "timestamp", "level")
