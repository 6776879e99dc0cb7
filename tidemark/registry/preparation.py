"""Queries of the composed jobs: prepared table, advanced features, lag features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.operators import features, preparation, windows
from tidemark.registry.core import query
from tidemark.registry.features import H, TS, WD, WE, i
from tidemark.registry.joins import COLS, WH, interpolated

HOLIDAYS = ("2024-01-01", "2024-01-06")
MODE = "(SELECT parking_type FROM o1 WHERE parking_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def carried(c: str) -> str:
    w = f"OVER (PARTITION BY location_id ORDER BY {TS} ROWS BETWEEN"
    return f"coalesce(last_value({c} IGNORE NULLS) {w} UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) {w} CURRENT ROW AND UNBOUNDED FOLLOWING))"


def at(c: str) -> str:
    return f"{interpolated(c, order=TS)} AS {c}"


STEPS = f"""r AS (SELECT location_id, date_trunc('hour', {TS}) AS "timestamp", avg(raw_value) AS v, max(capacity)::DOUBLE AS capacity, max(parking_type) AS kind FROM obs GROUP BY 1, 2),
    o0 AS (SELECT location_id, {TS}, CASE WHEN {H} % 7 <> 3 THEN v END AS occupancy, capacity, CASE WHEN {H} % 5 <> 2 THEN kind END AS parking_type FROM r),
    q AS (SELECT quantile_cont(occupancy, 0.25) AS a, quantile_cont(occupancy, 0.75) AS b FROM o0),
    o1 AS (SELECT location_id, {TS}, capacity, parking_type, CASE WHEN occupancy < a - 3 * (b - a) OR occupancy > b + 3 * (b - a)
      THEN least(greatest(occupancy, greatest(a - 3 * (b - a), 0)), least(b + 3 * (b - a), 100)) ELSE occupancy END AS occupancy FROM o0, q),
    o2 AS (SELECT location_id, {TS}, {at('occupancy')}, capacity, coalesce(parking_type, {MODE}) AS parking_type FROM o1),
    e AS (SELECT location_id, min({TS}) AS lo, max({TS}) AS hi FROM o2 GROUP BY 1),
    g AS (SELECT location_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS "timestamp" FROM e),
    j AS (SELECT g.location_id, g.{TS}, occupancy, capacity, parking_type FROM g LEFT JOIN o2 USING (location_id, {TS})),
    o3 AS (SELECT location_id, {TS}, {at('occupancy')}, {at('capacity')}, {carried('parking_type')} AS parking_type FROM j),
    z AS (SELECT location_id, {TS}, capacity, parking_type, CASE WHEN coalesce(abs((occupancy - avg(occupancy) OVER p) / nullif(stddev_samp(occupancy) OVER p, 0)) > 3, FALSE) THEN NULL ELSE occupancy END AS occupancy
      FROM o3 WINDOW p AS (PARTITION BY location_id)),
    o4 AS (SELECT location_id, {TS}, capacity, parking_type, {at('occupancy')} FROM z),
    m AS (SELECT o4.*, {', '.join(COLS)} FROM o4 LEFT JOIN wh ON wh.weather_time = date_trunc('hour', o4.{TS})),
    o5 AS (SELECT location_id, {TS}, capacity, parking_type, occupancy, {', '.join(at(c) for c in COLS)} FROM m),
    o6 AS (SELECT * REPLACE (CASE WHEN occupancy IS NOT NULL THEN least(greatest(CASE WHEN (SELECT max(occupancy) FROM o5) > 100 THEN occupancy / nullif(capacity, 0) * 100 ELSE occupancy END, 0.0), 100.0) END AS occupancy) FROM o5),
    o7 AS (SELECT location_id, {TS}, capacity, {carried('parking_type')} AS parking_type, {', '.join(at(c) for c in ('occupancy', *COLS))} FROM o6)"""


@query("pp1_prepared_table", ctes("obs", "weather", extra=f"{WH}, {STEPS}") + f"""SELECT location_id, {TS}, parking_type, {', '.join(f'round(CAST({c} AS DECIMAL(18, 9)), 4)::DOUBLE AS {c}' for c in ('capacity', 'occupancy', *COLS))}, {H} AS hour, {WD} AS weekday, month({TS}) AS "month", day({TS}) AS "day", {WE} AS is_weekend,
    CAST({TS} AS DATE) IN ({', '.join(f"DATE '{d}'" for d in HOLIDAYS)}) AS is_holiday,
    CASE WHEN {H} < 6 THEN 'night' WHEN {H} < 12 THEN 'morning' WHEN {H} < 18 THEN 'afternoon' ELSE 'evening' END AS time_category FROM o7""", digits=4)
def pp1(spark, root):
    """Hourly observations with gaps, outliers and missing categories to the model table."""
    o = fx.obs(spark, root).groupBy("location_id", F.date_trunc("hour", "timestamp").alias("timestamp")).agg(
        F.avg("raw_value").alias("occupancy"), F.max("capacity").cast("double").alias("capacity"), F.max("parking_type").alias("parking_type"))
    hour = F.hour("timestamp")
    o = o.withColumns({"occupancy": F.when(hour % 7 != 3, F.col("occupancy")), "parking_type": F.when(hour % 5 != 2, F.col("parking_type"))})
    days = fx.read_table(spark, root, "events").select(F.to_date("ts").alias("holiday")).distinct().where(F.col("holiday").isin(*[F.lit(d).cast("date") for d in HOLIDAYS]))
    out = preparation.prepare(o, fx.weather(spark, root), days)
    # means end in a five at any digit: decimals round them alike
    return out.withColumns({c: F.round(F.col(c).cast("decimal(18, 9)"), 4).cast("double") for c in ("capacity", "occupancy", *COLS)})


PEAK, HOT = f"{H} BETWEEN 7 AND 10", "temperature > 30"


@query("pp2_advanced_features", ctes("obs_weather") + f"""SELECT event_id, round(occupancy / capacity, 6) + 0.0 AS utilization_pct, {i(PEAK)} AS morning_peak, {i(f'{WD} = 5')} AS saturday,
    {i("parking_type = 'Public'")} AS "parking_type_Public", round(({i(PEAK)}) * temperature, 6) + 0.0 AS morning_peak_temperature, ({i(PEAK)}) * ({i('precipitation >= 10')}) AS morning_peak_heavy_rain,
    ({i("parking_type = 'Public'")}) * ({i('precipitation >= 10')}) AS "parking_type_Public_heavy_rain", round(ln(1 + precipitation), 6) + 0.0 AS log_precipitation, round(humidity * humidity, 6) AS humidity_squared FROM obs_weather""")
def pp2(spark, root):
    """Weather, time, utilisation, one-hot and interaction features in one call."""
    return features.advanced(fx.obs_weather(spark, root)).select(
        "event_id", "utilization_pct", "morning_peak", "saturday", "parking_type_Public", "morning_peak_temperature", "morning_peak_heavy_rain", "parking_type_Public_heavy_rain", "log_precipitation", "humidity_squared")


LAGGED = [*(f"occupancy_lag_{n}" for n in windows.LAGS), "occupancy_rolling_mean_3", "occupancy_rolling_std_3"]
ORDER = f"OVER (PARTITION BY location_id ORDER BY {TS}, event_id ROWS BETWEEN"


@query("pp3_lag_features", ctes("obs", extra=f"""l AS (SELECT event_id, location_id, {TS}, {', '.join(f'lag(occupancy, {k}) OVER w AS occupancy_lag_{n}' for n, k in windows.LAGS.items())},
    CASE WHEN count(*) {ORDER} 2 PRECEDING AND CURRENT ROW) = 3 THEN avg(occupancy) {ORDER} 2 PRECEDING AND CURRENT ROW) END AS occupancy_rolling_mean_3,
    CASE WHEN count(*) {ORDER} 2 PRECEDING AND CURRENT ROW) = 3 THEN stddev_samp(occupancy) {ORDER} 2 PRECEDING AND CURRENT ROW) END AS occupancy_rolling_std_3
    FROM obs WINDOW w AS (PARTITION BY location_id ORDER BY {TS}, event_id))""") + "SELECT event_id, " + ", ".join(
    f"round(coalesce(first_value({c} IGNORE NULLS) {ORDER} CURRENT ROW AND UNBOUNDED FOLLOWING), last_value({c} IGNORE NULLS) {ORDER} UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS {c}" for c in LAGGED) + " FROM l")
def pp3(spark, root):
    """Lags and three-row statistics, with the gaps they leave filled from the neighbours of the same location."""
    o = fx.obs(spark, root).select("event_id", "location_id", "timestamp", "occupancy")
    return windows.lag_features(o, ties=["event_id"]).select("event_id", *LAGGED)
