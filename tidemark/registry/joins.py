"""Queries of the join family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.operators import joins as op
from tidemark.registry.core import query
from tidemark.registry.features import TS, hav

WH = """wh AS (SELECT date_trunc('hour', weather_time) AS weather_time, avg(temperature) AS temperature, avg(humidity) AS humidity,
    avg(wind_speed) AS wind_speed, avg(precipitation) AS precipitation FROM weather GROUP BY 1)"""
COLS = ["temperature", "humidity", "wind_speed", "precipitation"]


def interpolated(c: str, part: str = "PARTITION BY location_id", order: str = f"{TS}, event_id", t: str = TS) -> str:
    """SQL of the time-weighted interpolation of column c."""
    p = f"last_value(CASE WHEN {c} IS NOT NULL THEN {{0}} END IGNORE NULLS) OVER ({part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    n = f"first_value(CASE WHEN {c} IS NOT NULL THEN {{0}} END IGNORE NULLS) OVER ({part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    pv, pt, nv, nt = p.format(c), p.format(f"epoch_us({t})"), n.format(c), n.format(f"epoch_us({t})")
    return (f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {pv} IS NULL THEN NULL WHEN {nv} IS NULL THEN {pv} WHEN {nt} = {pt} THEN {pv} "
            f"ELSE {pv} + ({nv} - {pv}) * ((epoch_us({t}) - {pt})::DOUBLE / ({nt} - {pt})::DOUBLE) END")


@query("jn1_weather_hour_join", ctes("obs", "weather", extra=WH) + f""", j AS (SELECT event_id, location_id, {TS}, {', '.join(COLS)}
    FROM obs LEFT JOIN wh ON date_trunc('hour', {TS}) = wh.weather_time) SELECT event_id, location_id, {TS},
    """ + ", ".join(f"round({interpolated(c)}, 6) AS {c}" for c in COLS) + " FROM j")
def jn1(spark, root):
    o = fx.obs(spark, root).select("event_id", "location_id", "timestamp")
    return op.join_weather_hour(o, op.weather_hourly(fx.weather(spark, root)))


GRID = WH + """, g AS (SELECT unnest(generate_series((SELECT min(weather_time) FROM wh), (SELECT max(weather_time) FROM wh), INTERVAL 1 HOUR)) AS t),
    w AS (SELECT g.t, wh.* EXCLUDE (weather_time) FROM g LEFT JOIN wh ON wh.weather_time = g.t)"""


@query("jn2_asof_nearest", ctes("obs", "weather", extra=GRID) + f""", b AS (SELECT o.event_id, o.{TS}, w.* FROM obs o ASOF LEFT JOIN w ON o.{TS} >= w.t),
    f AS (SELECT o.event_id, w.* FROM obs o ASOF LEFT JOIN w ON o.{TS} <= w.t),
    m AS (SELECT b.event_id, b.{TS}, f.t IS NULL OR (b.t IS NOT NULL AND epoch_us(b.{TS}) - epoch_us(b.t) <= epoch_us(f.t) - epoch_us(b.{TS})) AS back,
    b.t AS bt, f.t AS ft, """ + ", ".join(f"b.{c} AS b_{c}, f.{c} AS f_{c}" for c in COLS) + """ FROM b JOIN f USING (event_id))
    SELECT event_id, CASE WHEN back THEN bt ELSE ft END AS matched_weather_time, """ + ", ".join(
    f"round(CASE WHEN back THEN b_{c} ELSE f_{c} END, 6) AS {c}" for c in COLS) + " FROM m")
def jn2(spark, root):
    out = op.join_weather_nearest(fx.obs(spark, root).select("event_id", "timestamp"), fx.weather(spark, root))
    return out.drop("timestamp")


@query("jn3_event_impact", ctes("obs", "city_events") + f"""SELECT o.event_id, round(ln(coalesce(product(1 + e.impact_factor), 1.0)), 6) AS log_impact
    FROM obs o LEFT JOIN city_events e ON o.{TS} BETWEEN e.start_time AND e.end_time GROUP BY 1""")
def jn3(spark, root):
    o = fx.obs(spark, root).select("event_id", "timestamp")
    # products of two-digit factors sit on rounding ties, their logarithms do not, and stay finite
    return op.event_impact(o, fx.city_events(spark, root)).select("event_id", "log_impact")


@query("jn4_event_impact_near", ctes("obs", "city_events") + f"""SELECT o.event_id, round(least(greatest(coalesce(product(1 +
    exp(-({hav('o.latitude', 'o.longitude', 'e.event_lat', 'e.event_lon', '6371.0')}) / 2.0) * e.impact_factor), 1.0), 1.0), 3.0), 6) AS event_impact
    FROM obs o LEFT JOIN city_events e ON o.{TS} BETWEEN e.start_time AND e.end_time GROUP BY 1""")
def jn4(spark, root):
    o = fx.obs(spark, root).select("event_id", "timestamp", "latitude", "longitude")
    return op.event_impact_near(o, fx.city_events(spark, root)).select("event_id", "event_impact")


D = hav("p.latitude", "p.longitude", "f.latitude", "f.longitude", "6371000.0")
NEAR = f"""d AS (SELECT p.point_id, f.facility_id, {D} AS distance_m FROM points p, facilities f),
    n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance_m, facility_id) AS rank FROM d)"""
QUALITY = """CASE WHEN distance_m > 0 AND distance_m <= 25 THEN 'Excellent' WHEN distance_m > 25 AND distance_m <= 50 THEN 'Good'
    WHEN distance_m > 50 AND distance_m <= 100 THEN 'Fair' WHEN distance_m > 100 THEN 'Poor' END"""
FINE = """CASE WHEN distance_m > 0 AND distance_m <= 25 THEN 'Excellent' WHEN distance_m > 25 AND distance_m <= 50 THEN 'Good'
    WHEN distance_m > 50 AND distance_m <= 75 THEN 'Fair' WHEN distance_m > 75 AND distance_m <= 100 THEN 'Poor' END"""


@query("jn5_nearest_within", ctes("points", "facilities", extra=NEAR) + f"""SELECT point_id, facility_id, round(distance_m, 4) AS distance_m,
    {QUALITY} AS match_quality FROM n WHERE rank = 1 AND distance_m < 500""", digits=4)
def jn5(spark, root):
    return op.match_facilities(fx.points(spark, root), fx.facilities(spark, root), 500.0).select(
        "point_id", "facility_id", "distance_m", "match_quality")


@query("jn6_k_nearest", ctes("points", "facilities", extra=NEAR) + """SELECT point_id, facility_id, rank, round(distance_m, 4) AS distance_m FROM n
    WHERE rank <= 3""", digits=4)
def jn6(spark, root):
    return op.nearest_facilities(fx.points(spark, root), fx.facilities(spark, root), 3).select("point_id", "facility_id", "rank", "distance_m")


@query("jn7_match_quality", ctes("points", "facilities", extra=NEAR) + f"""SELECT {QUALITY} AS quality, {FINE} AS quality_fine, count(*) AS count
    FROM n WHERE rank = 1 GROUP BY 1, 2""")
def jn7(spark, root):
    near = op.nearest_facilities(fx.points(spark, root), fx.facilities(spark, root), 1)
    d = F.col("distance_m")
    return near.groupBy(op.match_quality(d).alias("quality"), op.match_quality(d, op.QUALITY_FINE).alias("quality_fine")).agg(
        F.count(F.lit(1)).alias("count"))


@query("jn8_match_statistics", ctes("points", "facilities", extra=NEAR + ", a AS (SELECT * FROM n WHERE rank = 1)") + """SELECT count(*) AS total_points,
    count(*) FILTER (distance_m < 500) AS matches_found, count(DISTINCT facility_id) FILTER (distance_m < 500) AS unique_facilities_matched,
    round(min(distance_m) FILTER (distance_m < 500), 4) AS min_distance, round(max(distance_m) FILTER (distance_m < 500), 4) AS max_distance,
    round(avg(distance_m) FILTER (distance_m < 500), 4) AS mean_distance, round(count(*) FILTER (distance_m < 500) * 100.0 / count(*), 4)::DOUBLE AS matching_rate,
    (SELECT count(*) FROM facilities) AS total_facilities, round(quantile_cont(distance_m, 0.5) FILTER (distance_m < 500), 4) AS median_distance, """
    + ", ".join(f"round(quantile_cont(distance_m, {p / 100}), 4) AS p{p}" for p in (25, 50, 75, 90, 95)) + " FROM a", digits=4)
def jn8(spark, root):
    return op.match_statistics(fx.points(spark, root), fx.facilities(spark, root), 500.0)


def _corr_sql(f):
    return f"SELECT category AS variable, {f} AS correlation FROM features GROUP BY 1"


@query("jn9_method_comparison", ctes("features") + f""", a AS ({_corr_sql('avg(k) / 100')}), b AS ({_corr_sql('-max(value) / 1000')}),
    c AS ({_corr_sql('min(k) - 0.5')}) SELECT variable, round(a.correlation, 6) AS pearson, round(b.correlation, 6) AS spearman,
    round(c.correlation, 6) AS kendall, round((abs(a.correlation) + abs(b.correlation) + abs(c.correlation)) / 3, 6) AS mean_abs
    FROM a JOIN b USING (variable) JOIN c USING (variable)""")
def jn9(spark, root):
    g = fx.features(spark, root).groupBy(F.col("category").alias("variable"))
    return op.compare_methods({
        "pearson": g.agg((F.avg("k") / 100).alias("correlation")),
        "spearman": g.agg((-F.max("value") / 1000).alias("correlation")),
        "kendall": g.agg((F.min("k") - 0.5).alias("correlation"))})


@query("jn10_group_stats_join", ctes("obs") + f"""SELECT event_id, round(avg(occupancy) OVER (PARTITION BY hour({TS})), 6) AS hour_mean,
    round(stddev_samp(occupancy) OVER (PARTITION BY hour({TS})), 6) AS hour_std FROM obs""")
def jn10(spark, root):
    from tidemark.plans.ordered import with_group_stats

    o = fx.obs(spark, root).select("event_id", "occupancy", F.hour("timestamp").alias("hour"))
    return with_group_stats(o, ["hour"], hour_mean=F.avg("occupancy"), hour_std=F.stddev_samp("occupancy")).select(
        "event_id", "hour_mean", "hour_std")


@query("jn11_day_lookup", ctes("obs", "city_events", extra="""d AS (SELECT CAST(start_time AS DATE) AS day, 'event ' || min(event_id) AS special_event,
    max(impact_factor) AS impact FROM city_events GROUP BY 1)""") + f"""SELECT o.event_id, d.special_event, round(d.impact, 6) AS impact
    FROM obs o LEFT JOIN d ON CAST(o.{TS} AS DATE) = d.day""")
def jn11(spark, root):
    days = fx.city_events(spark, root).groupBy(F.to_date("start_time").alias("day")).agg(
        F.concat(F.lit("event "), F.min("event_id").cast("string")).alias("special_event"), F.max("impact_factor").alias("impact"))
    return op.lookup_day(fx.obs(spark, root), days, "timestamp", "day", ["special_event", "impact"]).select("event_id", "special_event", "impact")


HOLIDAYS = "(VALUES (DATE '2024-01-01'), (DATE '2024-01-06'), (DATE '2024-01-17'))"


@query("jn12_holiday_flags", ctes("obs", extra=f"h AS (SELECT * FROM {HOLIDAYS} v(holiday))") + f"""SELECT event_id,
    CAST({TS} AS DATE) IN (SELECT holiday FROM h) AS is_holiday, CAST({TS} AS DATE) + 1 IN (SELECT holiday FROM h) AS is_pre_holiday FROM obs""")
def jn12(spark, root):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-06",), ("2024-01-17",)], "holiday string").withColumn("holiday", F.to_date("holiday"))
    return op.holiday_flags(fx.obs(spark, root).select("event_id", "timestamp"), days, "timestamp").drop("timestamp")


REGISTRY = "r AS (SELECT 'LOC_' || (s_suppkey % 20) AS location_id, 'model_' || (s_suppkey % 20) AS model_id FROM supplier WHERE s_suppkey % 20 < 10 GROUP BY ALL)"


def registry(spark, root, with_global=True):
    n = F.col("s_suppkey") % 20
    own = fx.read_table(spark, root, "supplier").where(n < 10).select(
        F.concat(F.lit("LOC_"), n.cast("string")).alias("location_id"), F.concat(F.lit("model_"), n.cast("string")).alias("model_id")).distinct()
    if not with_global:
        return own
    return own.unionByName(spark.createDataFrame([(None, "model_global")], "location_id string, model_id string"))


@query("jn14_model_routing", ctes("obs", extra=REGISTRY) + """SELECT 'with_global' AS setup, event_id, coalesce(r.model_id, 'model_global') AS model_id,
    CASE WHEN r.model_id IS NULL THEN 'global' ELSE 'location' END AS route, NULL::VARCHAR AS error FROM obs LEFT JOIN r USING (location_id)
    UNION ALL SELECT 'without_global', event_id, r.model_id, CASE WHEN r.model_id IS NULL THEN 'none' ELSE 'location' END,
    CASE WHEN r.model_id IS NULL THEN 'no model for ' || obs.location_id END FROM obs LEFT JOIN r USING (location_id)""")
def jn14(spark, root):
    o = fx.obs(spark, root).select("event_id", "location_id")
    a = op.route_models(o, registry(spark, root)).withColumn("setup", F.lit("with_global"))
    b = op.route_models(o, registry(spark, root, False)).withColumn("setup", F.lit("without_global"))
    return a.unionByName(b).drop("location_id")


@query("jn15_orphan_report", """SELECT 'lineitem.part' AS relation, CAST(l_partkey * 2 AS VARCHAR) AS key, count(*) AS rows FROM lineitem
    WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part) GROUP BY ALL
    UNION ALL SELECT 'orders.customer', CAST(o_custkey + 5 AS VARCHAR), count(*) FROM orders WHERE o_custkey + 5 NOT IN (SELECT c_custkey FROM customer) GROUP BY ALL""")
def jn15(spark, root):
    li = fx.read_table(spark, root, "lineitem").select((F.col("l_partkey") * 2).alias("part"))
    o = fx.read_table(spark, root, "orders").select((F.col("o_custkey") + 5).alias("cust"))
    return op.orphans(li, fx.read_table(spark, root, "part"), "part", "p_partkey", "lineitem.part").unionByName(
        op.orphans(o, fx.read_table(spark, root, "customer"), "cust", "c_custkey", "orders.customer"))
