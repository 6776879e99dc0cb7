"""Queries of the scalar feature family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.functions import calendar, demand, weather
from tidemark.functions.constants import HOUR_PATTERNS, ZONES
from tidemark.functions.geo import EARTH_M, haversine
from tidemark.operators import features as op
from tidemark.registry.core import query

TS = '"timestamp"'
WD = f"(isodow({TS}) - 1)"
H = f"hour({TS})"
HM = f"(hour({TS}) + minute({TS}) / 60.0::DOUBLE)"
WE = f"(isodow({TS}) >= 6)"


def i(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END::BIGINT"


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


@query("sc1_calendar_parts", ctes("obs") + f"""SELECT event_id, {H} AS hour, {WD} AS weekday, month({TS}) AS "month", day({TS}) AS "day",
    dayofyear({TS}) AS day_of_year, weekofyear({TS}) AS iso_week, CAST({TS} AS DATE) AS "date", dayname({TS}) AS day_name,
    monthname({TS}) AS month_name FROM obs""")
def sc1(spark, root):
    return op.calendar_features(fx.obs(spark, root)).select("event_id", *calendar.parts(F.col("timestamp")))


@query("sc2_weekend_flag", ctes("obs") + f"SELECT event_id, {WE} AS is_weekend FROM obs")
def sc2(spark, root):
    return fx.obs(spark, root).select("event_id", calendar.is_weekend(F.col("timestamp")).alias("is_weekend"))


@query("sc3_cyclical", ctes("obs") + "SELECT event_id, " + ", ".join(
    r(f"{f}(2 * pi() * {x} / {p})", f"{n}_{f}") for n, x, p in
    (("hour", H, 24), ("weekday", WD, 7), ("month", f"month({TS})", 12), ("halfday", H, 12)) for f in ("sin", "cos")) + " FROM obs")
def sc3(spark, root):
    ts = F.col("timestamp")
    return fx.obs(spark, root).select("event_id", *[c.alias(n) for n, c in calendar.cyclical(ts).items()])


@query("sc4_slot_index", ctes("obs") + f"""SELECT event_id, slot_index, {r('sin(2 * pi() * slot_index / 144)', 'sin_time')},
    {r('cos(2 * pi() * slot_index / 144)', 'cos_time')} FROM (SELECT event_id, ({H} - 8) * 12 + minute({TS}) // 5 + 1 AS slot_index
    FROM obs)""")
def sc4(spark, root):
    slot = calendar.slot_from_eight(F.col("timestamp"))
    s, c = calendar.cycle(slot, 144)
    return fx.obs(spark, root).select("event_id", slot.alias("slot_index"), s.alias("sin_time"), c.alias("cos_time"))


@query("sc5_bounded_slot", ctes("obs") + f"""SELECT event_id, CASE WHEN {H} >= 8 AND {H} < 20 THEN (({H} - 8) * 60 + minute({TS})) // 5
    ELSE -1 END AS slot, {H} * 12 + minute({TS}) // 5 AS time_slot FROM obs""")
def sc5(spark, root):
    ts = F.col("timestamp")
    return fx.obs(spark, root).select("event_id", calendar.slot_in_hours(ts).alias("slot"), calendar.slot_of_day(ts).alias("time_slot"))


@query("sc6_time_category", ctes("obs") + f"""SELECT event_id, CASE WHEN {H} < 6 THEN 'night' WHEN {H} < 12 THEN 'morning'
    WHEN {H} < 18 THEN 'afternoon' ELSE 'evening' END AS time_category FROM obs""")
def sc6(spark, root):
    return fx.obs(spark, root).select("event_id", calendar.time_category(F.hour("timestamp")).alias("time_category"))


@query("sc7_period_flags", ctes("obs") + f"""SELECT event_id, {i(f'{H} BETWEEN 7 AND 10')} AS morning_peak,
    {i(f'{H} BETWEEN 11 AND 15')} AS midday, {i(f'{H} BETWEEN 16 AND 19')} AS evening_peak, {i(f'{H} >= 20 OR {H} <= 6')} AS night,
    {i(f'{H} BETWEEN 9 AND 17 AND NOT {WE}')} AS business_hours FROM obs""")
def sc7(spark, root):
    flags = calendar.period_flags(F.hour("timestamp"), calendar.is_weekend(F.col("timestamp")))
    return fx.obs(spark, root).select("event_id", *[c.alias(n) for n, c in flags.items()])


@query("sc8_day_flags", ctes("obs") + f"""SELECT event_id, {i(f'{WD} < 5')} AS workday, {i(f'{WD} = 0')} AS monday,
    {i(f'{WD} = 4')} AS friday, {i(f'{WD} = 5')} AS saturday, {i(f'{WD} = 6')} AS sunday FROM obs""")
def sc8(spark, root):
    return fx.obs(spark, root).select("event_id", *[c.alias(n) for n, c in calendar.day_flags(F.weekday("timestamp")).items()])


@query("sc9_offsets", ctes("obs") + f"""SELECT event_id, {r(HM, 'hours_since_midnight')}, day({TS}) - 1 AS days_since_month_start,
    day(last_day({TS})) - day({TS}) AS days_until_month_end FROM obs""")
def sc9(spark, root):
    return fx.obs(spark, root).select("event_id", *[c.alias(n) for n, c in calendar.offsets(F.col("timestamp")).items()])


@query("sc10_regulated_hours", ctes("obs") + f"""SELECT event_id, {i(f'{H} >= 8 AND {H} < 20')} AS regulated_hours,
    {H} BETWEEN 7 AND 18 AS is_operational FROM obs""")
def sc10(spark, root):
    h = F.hour("timestamp")
    return fx.obs(spark, root).select("event_id", calendar.regulated(h).alias("regulated_hours"),
                                      calendar.operational(h).alias("is_operational"))


@query("sc11_humidity_bands", ctes("obs_weather") + f"""SELECT event_id, {r('humidity * humidity', 'humidity_squared')},
    {i('s < 0.3')} AS humidity_low, {i('s >= 0.3 AND s < 0.7')} AS humidity_medium, {i('s >= 0.7')} AS humidity_high FROM
    (SELECT *, CASE WHEN max(humidity) OVER () > 1 THEN humidity / 100 ELSE humidity END AS s FROM obs_weather)""")
def sc11(spark, root):
    o = op.weather_features(fx.obs_weather(spark, root).drop("temperature", "precipitation"))
    return o.select("event_id", "humidity_squared", "humidity_low", "humidity_medium", "humidity_high")


@query("sc12_rain_bands", ctes("obs_weather") + f"""SELECT event_id, {i('precipitation = 0')} AS no_rain,
    {i('precipitation > 0 AND precipitation < 2.5')} AS light_rain, {i('precipitation >= 2.5 AND precipitation < 10')} AS moderate_rain,
    {i('precipitation >= 10')} AS heavy_rain, {r('ln(1 + precipitation)', 'log_precipitation')},
    {r('precipitation * precipitation', 'precipitation_squared')} FROM obs_weather""")
def sc12(spark, root):
    bands = weather.rain_bands(F.col("precipitation"))
    return fx.obs_weather(spark, root).select("event_id", *[c.alias(n) for n, c in bands.items()])


@query("sc13_temperature_bands", ctes("obs_weather") + f"""SELECT event_id, {i('temperature < 10')} AS temp_cold,
    {i('temperature >= 10 AND temperature < 20')} AS temp_mild, {i('temperature >= 20 AND temperature < 30')} AS temp_warm,
    {i('temperature >= 30')} AS temp_hot, {r('temperature + 0.1 * humidity', 'comfort_index')} FROM obs_weather""")
def sc13(spark, root):
    bands = weather.temperature_bands(F.col("temperature"), F.col("humidity"))
    return fx.obs_weather(spark, root).select("event_id", *[c.alias(n) for n, c in bands.items()])


@query("sc14_utilization", ctes("obs") + f"""SELECT event_id, {r('u', 'utilization_pct')}, {i('u < 0.3')} AS low_utilization,
    {i('u >= 0.3 AND u < 0.7')} AS medium_utilization, {i('u >= 0.7')} AS high_utilization
    FROM (SELECT event_id, occupancy / capacity AS u FROM obs)""")
def sc14(spark, root):
    return op.utilization_features(fx.obs(spark, root)).select("event_id", "utilization_pct", "low_utilization",
                                                              "medium_utilization", "high_utilization")


@query("sc15_one_hot", ctes("obs") + "SELECT event_id, " + ", ".join(
    f"{i(f'parking_type = {chr(39)}{v}{chr(39)}')} AS \"parking_type_{v}\"" for v in ("Mixed", "Public", "Resident")) + " FROM obs")
def sc15(spark, root):
    return op.one_hot(fx.obs(spark, root).select("event_id", "parking_type"), "parking_type").drop("parking_type")


_TIME = {"morning_peak": i(f"{H} BETWEEN 7 AND 10"), "midday": i(f"{H} BETWEEN 11 AND 15"), "evening_peak": i(f"{H} BETWEEN 16 AND 19"),
         "night": i(f"{H} >= 20 OR {H} <= 6"), "is_weekend": i(WE)}
_WEATHER = {"temperature": "temperature", "humidity": "humidity", "precipitation": "precipitation",
            "heavy_rain": i("precipitation >= 10"), "temp_hot": i("temperature >= 30")}


def _interaction_sql() -> str:
    cols = []
    for t, te in _TIME.items():
        for w, we in _WEATHER.items():
            whole = w in ("heavy_rain", "temp_hot")
            cols.append(f"({te}) * ({we}) AS {t}_{w}" if whole else r(f"({te}) * ({we})", f"{t}_{w}"))
    for v in ("Mixed", "Public", "Resident"):
        side = i(f"parking_type = '{v}'")
        for o, oe in {k: _TIME[k] for k in ("morning_peak", "evening_peak", "is_weekend")}.items():
            cols.append(f"({side}) * ({oe}) AS \"parking_type_{v}_{o}\"")
        for o in ("heavy_rain", "temp_hot"):
            cols.append(f"({side}) * ({_WEATHER[o]}) AS \"parking_type_{v}_{o}\"")
    return ctes("obs_weather") + "SELECT event_id, " + ",\n".join(cols) + " FROM obs_weather"


@query("sc16_interactions", _interaction_sql())
def sc16(spark, root):
    base = fx.obs_weather(spark, root)
    plain = op.weather_features(op.time_features(base))
    before = set(plain.columns)
    out = op.interactions(plain)
    return out.select("event_id", *[c for c in out.columns if c not in before])


@query("sc17_label_codes", ctes("obs") + """, t AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN location_id END AS loc FROM obs),
    d AS (SELECT loc, row_number() OVER (ORDER BY loc) - 1 AS code FROM (SELECT DISTINCT loc FROM t WHERE loc IS NOT NULL))
    SELECT event_id, coalesce(code, -1) AS zone_id_encoded FROM t LEFT JOIN d USING (loc)""")
def sc17(spark, root):
    t = fx.obs(spark, root).select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("location_id")).alias("loc"))
    return op.label_codes(t, "loc", "zone_id_encoded").drop("loc")


def hav(lat1, lon1, lat2, lon2, radius):
    return (f"2 * {radius} * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))")


@query("sc18_haversine", ctes("facilities") + f"""SELECT facility_id, {r(hav('latitude', 'longitude', '41.3851', '2.1734', '6371.0'), 'km')},
    {r(hav('latitude', 'longitude', '41.3851', '2.1734', '6371000.0'), 'metres')} FROM facilities""", digits=6)
def sc18(spark, root):
    args = (F.col("latitude"), F.col("longitude"), F.lit(41.3851), F.lit(2.1734))
    return fx.facilities(spark, root).select("facility_id", haversine(*args).alias("km"), haversine(*args, EARTH_M).alias("metres"))


DOWNTOWN = f"greatest(0.0, 1 - ({hav('latitude', 'longitude', '41.3851', '2.1734', '6371.0')}) / 10.0)"


@query("sc19_location_factors", ctes("facilities") + f"""SELECT facility_id, {r(hav('latitude', 'longitude', '41.3851', '2.1734', '6371.0'), 'distance_to_center')},
    {r(DOWNTOWN, 'downtown_influence')}, {r(f'1 - 0.7 * {DOWNTOWN}', 'residential_influence')},
    {r('least(1.0, capacity / 500.0)', 'capacity_factor')},
    {r(f'coalesce(0.5 + 0.5 * CASE WHEN facility_id % 2 = 0 THEN facility_id % 10 / 10.0 END, 0.3 + 0.7 * {DOWNTOWN})', 'traffic_sensitivity')}
    FROM facilities""")
def sc19(spark, root):
    traffic = F.when(F.col("facility_id") % 2 == 0, F.col("facility_id") % 10 / 10)
    f = demand.location_factors(F.col("latitude"), F.col("longitude"), F.col("capacity"), traffic)
    return fx.facilities(spark, root).select("facility_id", *[c.alias(n) for n, c in f.items()])


def comfort_sql(opt, winter, summer, width):
    m = f"month({TS})"
    shift = f"CASE WHEN {m} = 12 OR {m} <= 2 THEN {winter} WHEN {m} BETWEEN 6 AND 8 THEN {summer} ELSE 0 END"
    return f"exp(-pow(temperature - ({opt} + {shift}), 2) / (2 * {width} * {width}))"


COMFORT_SQL = comfort_sql(22.0, -5.0, 5.0, "10.0::DOUBLE")
SMOOTH_SQL = f"(1 - 0.4 * (1 - {comfort_sql(22.0, -3.0, 2.0, '5.0::DOUBLE')}))"
RAIN_SQL = "CASE WHEN precipitation > 0 THEN 1 - 0.3 * tanh(precipitation / 10) ELSE 1.0 END"
WIND_SQL = "least(greatest(1 - wind_speed / 50, 0.7), 1.0)"
HUMID_SQL = "(1 - 0.2 * least(greatest((humidity - 70) / 30, 0), 1))"
FACTOR_SQL = f"({COMFORT_SQL} * {RAIN_SQL} * {WIND_SQL} * {HUMID_SQL})"


@query("sc20_temp_comfort", ctes("obs_weather") + f"""SELECT event_id, {r(COMFORT_SQL, 'comfort')}, {r(SMOOTH_SQL, 'smooth_comfort')}
    FROM obs_weather""")
def sc20(spark, root):
    from tidemark.functions.constants import SMOOTH_COMFORT

    t, m = F.col("temperature"), F.month("timestamp")
    return fx.obs_weather(spark, root).select("event_id", weather.comfort(t, m).alias("comfort"),
                                              weather.comfort(t, m, SMOOTH_COMFORT).alias("smooth_comfort"))


@query("sc21_weather_factor", ctes("obs_weather") + f"""SELECT event_id, {r(FACTOR_SQL, 'weather_factor')},
    {r(f'{COMFORT_SQL} * (1 - 0.2 * least(greatest(precipitation, 0), 1)) * (1 - 0.1 * least(greatest(wind_speed / 20, 0), 1))', 'weather_impact')},
    {r(f'{SMOOTH_SQL} * {RAIN_SQL} * {WIND_SQL} * {HUMID_SQL}', 'smooth_factor')} FROM obs_weather""")
def sc21(spark, root):
    t, h, w, p, m = F.col("temperature"), F.col("humidity"), F.col("wind_speed"), F.col("precipitation"), F.month("timestamp")
    return fx.obs_weather(spark, root).select(
        "event_id", weather.factor(t, h, w, p, m).alias("weather_factor"), weather.impact(t, w, p, m).alias("weather_impact"),
        weather.smooth_factor(t, h, w, p, m).alias("smooth_factor"))


TRAFFIC_SQL = (f"(0.5 * CASE WHEN {WE} THEN 0.8 ELSE 1.2 END * CASE WHEN {H} >= 7 AND {H} < 9 THEN 1.5 ELSE 1.0 END"
               f" * CASE WHEN {H} >= 16 AND {H} < 19 THEN 1.4 ELSE 1.0 END)::DOUBLE")


@query("sc22_traffic_factor", ctes("obs") + f"SELECT event_id, {r(TRAFFIC_SQL, 'traffic_factor')} FROM obs")
def sc22(spark, root):
    ts = F.col("timestamp")
    return fx.obs(spark, root).select("event_id", demand.traffic_factor(F.hour(ts), calendar.is_weekend(ts)).alias("traffic_factor"))


def pattern_sql(kind):
    p = HOUR_PATTERNS[kind]
    return f"(CASE WHEN {WE} THEN {p['weekend']}[{H} + 1] ELSE {p['weekday']}[{H} + 1] END)::DOUBLE"


PATTERN_SQL = f"CASE parking_type WHEN 'Public' THEN {pattern_sql('Public')} WHEN 'Resident' THEN {pattern_sql('Resident')} END"


@query("sc23_hour_pattern", ctes("obs") + f"""SELECT event_id, {PATTERN_SQL} AS pattern, {r(f'({PATTERN_SQL}) * 100', 'base_occupancy')}
    FROM obs""")
def sc23(spark, root):
    ts = F.col("timestamp")
    args = (F.col("parking_type"), F.hour(ts), calendar.is_weekend(ts))
    return fx.obs(spark, root).select("event_id", demand.hour_pattern(*args).alias("pattern"),
                                      demand.base_occupancy(*args).alias("base_occupancy"))


@query("sc24_time_factor", ctes("obs") + f"""SELECT event_id, {r(f'''least(greatest(CASE parking_type WHEN 'Public' THEN
    (CASE WHEN {H} BETWEEN 8 AND 17 THEN 0.8 ELSE 1 END) * (CASE WHEN {H} BETWEEN 11 AND 13 THEN 0.9 ELSE 1 END)
    * (CASE WHEN {H} BETWEEN 18 AND 21 THEN 0.7 ELSE 1 END) * (CASE WHEN {WE} THEN 0.7 ELSE 1 END)
    WHEN 'Resident' THEN (CASE WHEN {H} BETWEEN 17 AND 23 THEN 0.9 ELSE 1 END) * (CASE WHEN {H} BETWEEN 0 AND 6 THEN 0.8 ELSE 1 END)
    * (CASE WHEN {WE} THEN 0.9 ELSE 1 END) ELSE 1 END::DOUBLE, 0.0), 1.0)''', 'time_factor')} FROM obs""")
def sc24(spark, root):
    ts = F.col("timestamp")
    return fx.obs(spark, root).select(
        "event_id", demand.time_factor(F.col("parking_type"), F.hour(ts), calendar.is_weekend(ts)).alias("time_factor"))


@query("sc25_arrival_probability", ctes("obs") + f"""SELECT event_id, {r(f'''least(greatest(CASE parking_type WHEN 'Public' THEN
    (CASE WHEN {H} BETWEEN 17 AND 19 THEN 0.10 WHEN {H} BETWEEN 12 AND 14 THEN 0.12 WHEN {H} BETWEEN 8 AND 10 THEN 0.15 ELSE 0.05 END)
    * (CASE WHEN {WE} THEN 0.7 ELSE 1 END) WHEN 'Resident' THEN CASE WHEN {WE} AND {H} BETWEEN 10 AND 18 THEN 0.12
    WHEN {H} BETWEEN 18 AND 21 THEN 0.15 ELSE 0.05 END ELSE 0.05 END::DOUBLE, 0.01), 0.3)''', 'arrival_probability')} FROM obs""")
def sc25(spark, root):
    ts = F.col("timestamp")
    return fx.obs(spark, root).select("event_id", demand.arrival_probability(
        F.col("parking_type"), F.hour(ts), calendar.is_weekend(ts)).alias("arrival_probability"))


SCORE_SQL = f"""least(greatest(0.5 * coalesce({PATTERN_SQL}, {pattern_sql('Public')}) * 100
    + 0.4 * {TRAFFIC_SQL} * (0.3 + 0.7 * {DOWNTOWN}) + 0.3 * ({DOWNTOWN} + 1 - 0.7 * {DOWNTOWN}) + 0.2 * {FACTOR_SQL}
    + 0.2 * least(1.0, capacity / 500.0), 0.0), 100.0)"""


@query("sc29_rule_score", ctes("obs_weather") + f"SELECT event_id, {r(SCORE_SQL, 'score')} FROM obs_weather")
def sc29(spark, root):
    return op.rule_scores(fx.obs_weather(spark, root)).select("event_id", "score")


@query("sc30_confidence", ctes("raw_dirty") + """SELECT record_id, round(0.7 + 0.25 * (1 - 2 * abs(occupancy_rate - 0.5)), 10) AS confidence
    FROM raw_dirty""", digits=10)
def sc30(spark, root):
    from tidemark.operators.repair import confidence

    return fx.raw_dirty(spark, root).select("record_id", confidence(F.col("occupancy_rate")).alias("confidence"))


@query("sc31_level_labels", ctes("segments") + """SELECT event_id, CASE level WHEN 0 THEN 'No prediction'
    WHEN 1 THEN 'High availability (>80%)' WHEN 2 THEN 'Medium availability (30-80%)' ELSE 'Low availability (<10%)' END AS label
    FROM segments""")
def sc31(spark, root):
    return fx.segments(spark, root).select("event_id", op.level_labels(F.col("level")).alias("label"))


def zone_sql() -> str:
    infl = {n: f"exp(-sqrt(pow(latitude - {a}, 2) + pow(longitude - {b}, 2)) / {rad})" for n, a, b, rad, _ in ZONES}
    inner = ", ".join(f"{e} AS {n}_influence" for n, e in infl.items())
    w = " + ".join(f"{s} * {n}_influence" for n, *_, s in ZONES)
    sens = " + ".join(f"{s} * {s} * {n}_influence" for n, *_, s in ZONES)
    pull = " + ".join(f"{s} * {n}_influence * {n}_influence" for n, *_, s in ZONES)
    outs = ", ".join(r(f"{n}_influence", f"{n}_influence") for n, *_ in ZONES)
    return ctes("facilities") + f"""SELECT facility_id, {r('1.0 - 0.1 * (capacity / 1000.0)', 'capacity_factor')},
        CASE parking_type WHEN 'Public' THEN 1.0 WHEN 'Resident' THEN 0.9 WHEN 'Mixed' THEN 0.95 ELSE 1.0 END::DOUBLE AS type_factor,
        {r(f'least(greatest(0.5 + ({sens}) / ({w}) / 1.5, 0.5), 1.5)', 'traffic_sensitivity')},
        {r(f'least(greatest(0.5 + ({pull}) / ({w}), 0.5), 1.5)', 'zone_impact')}, {outs}
        FROM (SELECT *, {inner} FROM facilities)"""


@query("jn13_zone_influence", zone_sql())
def jn13(spark, root):
    f = demand.zone_factors(F.col("latitude"), F.col("longitude"), F.col("capacity"), F.col("parking_type"))
    return fx.facilities(spark, root).select("facility_id", *[c.alias(n) for n, c in f.items()])
