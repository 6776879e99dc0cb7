"""Queries of the validation, repair and data-quality family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.functions import rules
from tidemark.operators import quality as op
from tidemark.operators import repair
from tidemark.registry.core import query
from tidemark.registry.features import TS
from tidemark.registry.joins import interpolated


def bad(cond: str, name: str) -> str:
    return f"CASE WHEN NOT coalesce({cond}, FALSE) THEN '{name}' END"


def t_ok(c: str) -> str:
    return f"TRY_CAST({c} AS TIMESTAMP) IS NOT NULL"


LOC = "regexp_full_match(location_id, '[A-Za-z0-9_-]+')"
FEATURE = [bad("occupancy_rate BETWEEN 0 AND 1", "invalid_occupancy_rate"), bad(LOC, "invalid_location_id"), bad(t_ok(TS), "invalid_timestamp"),
           bad("lower(is_holiday) IN ('true', 'false', '0', '1')", "invalid_is_holiday"), bad("day_of_week BETWEEN 0 AND 6", "invalid_day_of_week"),
           bad("hour_of_day BETWEEN 0 AND 23", "invalid_hour_of_day")]
PREDICTION = [bad("predicted_occupancy BETWEEN 0 AND 1", "invalid_predicted_occupancy"), bad(LOC, "invalid_location_id"),
              bad(t_ok("prediction_timestamp"), "invalid_prediction_timestamp"), bad(t_ok("predicted_for_timestamp"), "invalid_predicted_for_timestamp"),
              bad("trim(model_version) <> ''", "invalid_model_version")]
EXPECTED = "CASE WHEN total_spots > 0 THEN 1 - available_spots / total_spots::DOUBLE ELSE 0 END"
RAW = [FEATURE[0], FEATURE[1], FEATURE[2], bad("total_spots > 0", "invalid_total_spots"),
       "CASE WHEN NOT coalesce(available_spots >= 0, FALSE) OR coalesce(available_spots > total_spots, FALSE) THEN 'invalid_available_spots' END",
       f"""CASE WHEN total_spots IS NOT NULL AND available_spots IS NOT NULL AND occupancy_rate IS NOT NULL
    AND abs({EXPECTED} - occupancy_rate) > 0.01 THEN 'inconsistent_occupancy_calculation' END"""]


def joined(parts):
    return "coalesce(concat_ws(';', " + ", ".join(parts) + "), '')"


def flat(df):
    return df.select("record_id", F.array_join("reasons", ";").alias("reasons"))


@query("dq1_validate_features", ctes("raw_dirty") + f"SELECT record_id, {joined(FEATURE)} AS reasons FROM raw_dirty")
def dq1(spark, root):
    return flat(op.validate(fx.raw_dirty(spark, root), "feature"))


@query("dq2_validate_predictions", ctes("dirty_predictions") + f"SELECT record_id, {joined(PREDICTION)} AS reasons FROM dirty_predictions")
def dq2(spark, root):
    return flat(op.validate(fx.dirty_predictions(spark, root), "prediction"))


@query("dq3_validate_raw", ctes("raw_dirty") + f"SELECT record_id, {joined(RAW)} AS reasons FROM raw_dirty")
def dq3(spark, root):
    return flat(op.validate(fx.raw_dirty(spark, root), "raw"))


@query("dq4_validation_summary", ctes("raw_dirty", extra=f"v AS (SELECT {joined(RAW)} AS r FROM raw_dirty)") + """SELECT item, round(amount, 6) AS amount FROM (
    SELECT 'total_count' AS item, count(*)::DOUBLE AS amount FROM v UNION ALL SELECT 'invalid_count', count(*) FILTER (r <> '') FROM v
    UNION ALL SELECT 'valid_count', count(*) FILTER (r = '') FROM v UNION ALL SELECT 'valid_percentage', count(*) FILTER (r = '') * 100.0 / count(*) FROM v
    UNION ALL SELECT reason, count(*) FROM (SELECT unnest(string_split(r, ';')) AS reason FROM v WHERE r <> '') GROUP BY reason)""")
def dq4(spark, root):
    return op.validation_summary(op.validate(fx.raw_dirty(spark, root), "raw"))


@query("dq5_invalid_sample", ctes("raw_dirty") + f"""SELECT record_id, reasons FROM (SELECT record_id, {joined(FEATURE)} AS reasons FROM raw_dirty)
    WHERE reasons <> '' ORDER BY record_id LIMIT 10""")
def dq5(spark, root):
    return flat(op.invalid_sample(op.validate(fx.raw_dirty(spark, root), "feature"), "record_id"))


@query("dq6_field_predicates", ctes("raw_dirty") + f"""SELECT record_id, {LOC} AS location_ok, {t_ok(TS)} AS time_ok,
    lower(is_holiday) IN ('true', 'false', '0', '1') AS flag_ok, TRY_CAST({TS} AS TIMESTAMP) AS parsed FROM raw_dirty""")
def dq6(spark, root):
    return fx.raw_dirty(spark, root).select(
        "record_id", rules.valid_location(F.col("location_id")).alias("location_ok"), rules.valid_time(F.col("timestamp")).alias("time_ok"),
        rules.valid_flag(F.col("is_holiday")).alias("flag_ok"), rules.parse_time(F.col("timestamp")).alias("parsed"))


CLIPPED = "least(greatest({0}, 0.0::DOUBLE), 1.0::DOUBLE)"


def clipped(c):
    return f"CASE WHEN {c} IS NOT NULL THEN {CLIPPED.format(c)} END"


MODE = "(SELECT {0} FROM raw_dirty WHERE {0} BETWEEN 0 AND {1} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
MED_TIME = f"(SELECT make_timestamp(CAST(floor(quantile_cont(epoch_us(TRY_CAST({TS} AS TIMESTAMP)), 0.5)) AS BIGINT)) FROM raw_dirty)"


@query("dq7_fix_features", ctes("raw_dirty", extra=f"""c AS (SELECT *, {clipped('occupancy_rate')} AS r, TRY_CAST({TS} AS TIMESTAMP) AS tm FROM raw_dirty),
    f AS (SELECT record_id, coalesce(r, (SELECT quantile_cont(r, 0.5) FROM c)) AS occupancy_rate, CASE WHEN is_holiday IN ('true', '1') THEN 1 ELSE 0 END::BIGINT AS is_holiday,
    CAST(CASE WHEN day_of_week BETWEEN 0 AND 6 THEN day_of_week ELSE coalesce(isodow(tm) - 1, {MODE.format('day_of_week', 6)}) END AS BIGINT) AS day_of_week,
    CAST(CASE WHEN hour_of_day BETWEEN 0 AND 23 THEN hour_of_day ELSE coalesce(hour(tm), {MODE.format('hour_of_day', 23)}) END AS BIGINT) AS hour_of_day,
    coalesce(tm, {MED_TIME}) AS "timestamp" FROM c)""") + f"""SELECT record_id, round(occupancy_rate, 9) AS occupancy_rate, is_holiday, day_of_week, hour_of_day, {TS},
    CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END::BIGINT AS is_weekend FROM f""", digits=9)
def dq7(spark, root):
    return repair.fix_features(fx.raw_dirty(spark, root)).select(
        "record_id", "occupancy_rate", "is_holiday", "day_of_week", "hour_of_day", "timestamp", "is_weekend")


@query("dq8_fix_predictions", ctes("dirty_predictions", extra=f"""c AS (SELECT *, {clipped('predicted_occupancy')} AS p FROM dirty_predictions),
    f AS (SELECT record_id, coalesce(p, (SELECT quantile_cont(p, 0.5) FROM c)) AS predicted_occupancy,
    coalesce(TRY_CAST(prediction_timestamp AS TIMESTAMP), TIMESTAMP '2024-02-01 00:00:00') AS made, TRY_CAST(predicted_for_timestamp AS TIMESTAMP) AS meant,
    coalesce(model_version, (SELECT model_version FROM c WHERE model_version IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS model_version FROM c)""") + """
    SELECT record_id, round(predicted_occupancy, 11) AS predicted_occupancy, made AS prediction_timestamp, coalesce(meant, made + INTERVAL 1 HOUR) AS predicted_for_timestamp,
    model_version, round(0.7 + 0.25 * (1 - 2 * abs(predicted_occupancy - 0.5)), 11) AS confidence FROM f""", digits=11)
def dq8(spark, root):
    return repair.fix_predictions(fx.dirty_predictions(spark, root), "2024-02-01 00:00:00").drop("location_id")


@query("dq9_fix_raw", ctes("raw_dirty", extra=f"""a AS (SELECT *, {clipped('''(CASE WHEN occupancy_rate BETWEEN 0 AND 1 THEN occupancy_rate
    WHEN total_spots > 0 AND available_spots IS NOT NULL THEN 1 - available_spots / total_spots::DOUBLE ELSE occupancy_rate END)''')} AS r FROM raw_dirty),
    lm AS (SELECT location_id, quantile_cont(total_spots, 0.5) AS m FROM raw_dirty WHERE total_spots > 0 AND location_id IS NOT NULL GROUP BY 1),
    b AS (SELECT a.*, coalesce(r, (SELECT quantile_cont(r, 0.5) FROM a)) AS rate, CASE WHEN total_spots > 0 THEN total_spots::DOUBLE ELSE lm.m END AS t1 FROM a LEFT JOIN lm USING (location_id)),
    c AS (SELECT *, coalesce(t1, (SELECT quantile_cont(t1, 0.5) FROM b), 100) AS total FROM b),
    d AS (SELECT *, CASE WHEN available_spots IS NULL OR available_spots < 0 THEN round_even(total * (1 - rate), 0) WHEN available_spots > total THEN total
    ELSE available_spots::DOUBLE END AS avail FROM c), e AS (SELECT *, CASE WHEN total > 0 THEN 1 - avail / total ELSE 0 END AS expected FROM d)""") + f"""
    SELECT record_id, round(total, 6) AS total_spots, round(avail, 6) + 0.0 AS available_spots, round(CASE WHEN abs(expected - rate) > 0.01 THEN expected ELSE rate END, 9) AS occupancy_rate,
    coalesce(TRY_CAST({TS} AS TIMESTAMP), {MED_TIME}) AS "timestamp" FROM e""", digits=9)
def dq9(spark, root):
    return repair.fix_raw(fx.raw_dirty(spark, root)).select("record_id", "total_spots", "available_spots", "occupancy_rate", "timestamp")


BOUNDS = """b AS (SELECT q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))"""


@query("dq10_iqr_outliers", ctes("obs", extra=BOUNDS.format(k=3.0, c="raw_value", t="obs")) + """SELECT 'clip' AS how, event_id, round(CASE WHEN raw_value < lo OR raw_value > hi
    THEN least(greatest(raw_value, greatest(lo, 0.0)), least(hi, 100.0)) ELSE raw_value END, 6) AS v FROM obs, b
    UNION ALL SELECT 'drop', event_id, round(raw_value, 6) FROM obs, b WHERE raw_value BETWEEN lo AND hi""")
def dq10(spark, root):
    o = fx.obs(spark, root).select("event_id", "raw_value")
    a = repair.iqr_outliers(o.withColumnRenamed("raw_value", "occupancy")).select(F.lit("clip").alias("how"), "event_id", F.col("occupancy").alias("v"))
    b = repair.iqr_outliers(o, "raw_value").select(F.lit("drop").alias("how"), "event_id", F.col("raw_value").alias("v"))
    return a.unionByName(b)


@query("dq11_zscore_outliers", ctes("raw_dirty", extra="""f AS (SELECT record_id, occupancy_rate, coalesce(occupancy_rate, (SELECT quantile_cont(occupancy_rate, 0.5) FROM raw_dirty)) AS f FROM raw_dirty),
    z AS (SELECT *, abs(f - avg(f) OVER ()) / stddev_pop(f) OVER () AS z FROM f)""") + """SELECT record_id, round(occupancy_rate, 9) AS occupancy_rate FROM z WHERE z <= 1.5""", digits=9)
def dq11(spark, root):
    return repair.zscore_outliers(fx.raw_dirty(spark, root).select("record_id", "occupancy_rate"), "occupancy_rate", 1.5)


GAPS = f"""g AS (SELECT event_id, location_id, CASE WHEN event_id % 50 <> 0 THEN {TS} END AS "timestamp", CASE WHEN event_id % 3 <> 0 THEN raw_value END AS raw_value,
    CASE WHEN event_id % 4 <> 0 THEN parking_type END AS parking_type FROM obs), h AS (SELECT * FROM g WHERE {TS} IS NOT NULL)"""


@query("dq12_fill_missing", ctes("obs", extra=GAPS) + f""", m AS (SELECT parking_type AS p FROM h WHERE parking_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT 'interpolate' AS how, event_id, round({interpolated('raw_value')}, 6) AS raw_value, coalesce(parking_type, (SELECT p FROM m)) AS parking_type FROM h
    UNION ALL SELECT 'mean', event_id, round(coalesce(raw_value, (SELECT avg(raw_value) FROM h)), 6), coalesce(parking_type, (SELECT p FROM m)) FROM h
    UNION ALL SELECT 'median', event_id, round(coalesce(raw_value, (SELECT quantile_cont(raw_value, 0.5) FROM h)), 6), coalesce(parking_type, (SELECT p FROM m)) FROM h""")
def dq12(spark, root):
    n = F.col("event_id")
    g = fx.obs(spark, root).select(
        "event_id", "location_id", F.when(n % 50 != 0, F.col("timestamp")).alias("timestamp"),
        F.when(n % 3 != 0, F.col("raw_value")).alias("raw_value"), F.when(n % 4 != 0, F.col("parking_type")).alias("parking_type"))
    out = None
    for how in ("interpolate", "mean", "median"):
        one = repair.fill_missing(g, how, ties=["event_id"]).select(F.lit(how).alias("how"), "event_id", "raw_value", "parking_type")
        out = one if out is None else out.unionByName(one)
    return out


def _outliers(c, name):
    return f"""SELECT '{name}' AS column_name, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, count(*) FILTER (v < lo OR v > hi) AS outliers,
        round(count(*) FILTER (v < lo OR v > hi) * 100.0 / count(*), 6)::DOUBLE AS outlier_pct FROM (SELECT {c} AS v, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
        FROM features, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM features)) GROUP BY lo, hi"""


@query("dq13_outlier_counts", ctes("features") + " UNION ALL ".join(_outliers(c, n) for c, n in (("value", "value"), ("k", "k"), ('"load"', "load"))))
def dq13(spark, root):
    return op.outlier_counts(fx.features(spark, root), ["value", "k", "load"])


COLS = ["value", "k", "load"]
PROFILE = ", ".join(["prof AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg(\"{c}\") AS m, stddev_pop(\"{c}\") AS s FROM reference" for c in COLS) + ")",
    "longc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN event_id % 11 <> 0 THEN \"{c}\" END AS v FROM \"current\"" for c in COLS) + ")"])


def holed(spark, root):
    keep = F.col("event_id") % 11 != 0
    return fx.current(spark, root).select(*[F.when(keep, F.col(c)).alias(c) for c in COLS])


@query("dq14_quality_rates", ctes("reference", "current", extra=PROFILE) + """SELECT column_name, count(*) AS rows, round(avg((v IS NULL)::INT), 6) AS missing_rate,
    round(count(*) FILTER (v < m - 3 * s OR v > m + 3 * s) / count(*)::DOUBLE, 6) AS out_of_range_rate FROM longc JOIN prof USING (column_name) GROUP BY 1""")
def dq14(spark, root):
    return op.quality_rates(holed(spark, root), op.reference_profile(fx.reference(spark, root), COLS), COLS)


PAIRS = [("value", "k"), ("value", "load"), ("k", "load")]
CHG = "chg AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, r.c AS ref_corr, n.c AS cur_corr FROM (SELECT corr("{a}", "{b}") AS c FROM reference) r, (SELECT corr("{a}", "{b}") AS c FROM "current") n"""
    for a, b in PAIRS) + ")"


@query("dq15_correlation_changes", ctes("reference", "current", extra=CHG) + """SELECT feature_a, feature_b, round(ref_corr, 6) AS ref_corr, round(cur_corr, 6) AS cur_corr,
    round(cur_corr - ref_corr, 6) + 0.0 AS change FROM chg WHERE abs(cur_corr - ref_corr) > 0.001""")
def dq15(spark, root):
    return op.correlation_changes(fx.reference(spark, root), fx.current(spark, root), COLS, 0.001)


def cdf_sql(z):
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({z}) / sqrt(2)))"
    poly = f"(((((1.061405429::DOUBLE * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    tail = f"({poly} * exp(-({z}) * ({z}) / 2) / 2)"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


def ks_sql(x):
    return f"""CASE WHEN {x} < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END)
        * exp(-2.0::DOUBLE * j * j * {x} * {x}))), 0.0), 1.0) END"""


SHIFT = PROFILE + f""", vc AS (SELECT column_name, v, count(*) AS n FROM longc WHERE v IS NOT NULL GROUP BY 1, 2),
    cum AS (SELECT *, sum(n) OVER (PARTITION BY column_name ORDER BY v) AS upto, sum(n) OVER (PARTITION BY column_name) AS total FROM vc),
    gap AS (SELECT column_name, total, greatest(upto / total - {cdf_sql('(v - m) / s')}, {cdf_sql('(v - m) / s')} - (upto - n) / total) AS g FROM cum JOIN prof USING (column_name)),
    d AS (SELECT column_name, max(g) AS ks, CAST(any_value(total) AS BIGINT) AS total FROM gap GROUP BY 1),
    st AS (SELECT column_name, avg(v) AS cm, stddev_pop(v) AS cs FROM longc GROUP BY 1),
    sh AS (SELECT column_name, (cm - m) / s AS mean_shift, cs / s AS std_ratio, ks, total, {ks_sql('(sqrt(total) * ks)')} AS p FROM d JOIN prof USING (column_name) JOIN st USING (column_name))"""


@query("dq16_distribution_shift", ctes("reference", "current", extra=SHIFT) + """SELECT column_name, round(mean_shift, 6) + 0.0 AS mean_shift, round(std_ratio, 6) AS std_ratio, round(ks, 6) AS ks_statistic,
    round(p, 6) AS p_value, p < 0.05 AS is_significant, total AS sample_size FROM sh""")
def dq16(spark, root):
    return op.distribution_shift(holed(spark, root), op.reference_profile(fx.reference(spark, root), COLS), COLS)


def _parts(spark, root):
    prof = op.reference_profile(fx.reference(spark, root), COLS)
    h = holed(spark, root)
    return op.quality_rates(h, prof, COLS), op.correlation_changes(fx.reference(spark, root), fx.current(spark, root), COLS, 0.001), op.distribution_shift(h, prof, COLS)


RATES = """rt AS (SELECT column_name, avg((v IS NULL)::INT) AS mr, count(*) FILTER (v < m - 3 * s OR v > m + 3 * s) / count(*)::DOUBLE AS orr FROM longc JOIN prof USING (column_name) GROUP BY 1),
    cc AS (SELECT * FROM chg WHERE abs(cur_corr - ref_corr) > 0.001)"""


@query("dq17_quality_score", ctes("reference", "current", extra=f"{SHIFT}, {CHG}, {RATES}") + """SELECT round(mr, 6) AS missing_rate, round(orr, 6) AS out_of_range_rate,
    round((1 - mr) * (1 - orr) * greatest(0, 1 - coalesce((SELECT avg(abs(cur_corr - ref_corr)) FROM cc), 0)) * greatest(0, 1 - coalesce((SELECT avg(ks) FROM sh WHERE p < 0.05), 0)), 6) AS quality_score
    FROM (SELECT avg(mr) AS mr, avg(orr) AS orr FROM rt)""")
def dq17(spark, root):
    return op.quality_score(*_parts(spark, root))


@query("dq18_issue_importance", ctes("reference", "current", extra=f"{SHIFT}, {CHG}, {RATES}") + """, x AS (SELECT column_name, sum(x) AS x FROM (SELECT column_name, 0.0::DOUBLE AS x FROM rt
    UNION ALL SELECT column_name, ks FROM sh WHERE p < 0.05 UNION ALL SELECT feature_a, abs(cur_corr - ref_corr) / 2 FROM cc UNION ALL SELECT feature_b, abs(cur_corr - ref_corr) / 2 FROM cc) GROUP BY 1)
    SELECT column_name, round(x / (SELECT max(x) FROM x), 6) AS importance FROM x""")
def dq18(spark, root):
    return op.issue_importance(*_parts(spark, root))


@query("dq19_validate_metrics", ctes("metrics") + f"""SELECT event_id, concat_ws(';', CASE WHEN event_id % 13 = 0 THEN 'missing_model_id' END, CASE WHEN event_id % 17 = 0 THEN 'value_not_finite' END,
    CASE WHEN {TS} > TIMESTAMP '2024-01-25 00:00:00' THEN 'timestamp_in_future' END) AS reasons FROM metrics""")
def dq19(spark, root):
    n = F.col("event_id")
    m = fx.metrics(spark, root).withColumn("model_id", F.when(n % 13 != 0, F.col("model_id"))).withColumn(
        "value", F.when(n % 17 != 0, F.col("value")).when(n % 34 == 0, float("inf")).otherwise(float("nan")))
    return op.validate_metrics(m, "2024-01-25 00:00:00").select("event_id", F.array_join("reasons", ";").alias("reasons"))


@query("dq20_metric_violations", ctes("scored_metrics") + """SELECT event_id, metric_name, CASE metric_name WHEN 'rmse' THEN 0.5 WHEN 'mae' THEN 0.4 ELSE 0.7 END::DOUBLE AS threshold,
    CASE metric_name WHEN 'r2' THEN 'below' ELSE 'above' END AS direction FROM scored_metrics
    WHERE (metric_name = 'rmse' AND value > 0.5) OR (metric_name = 'mae' AND value > 0.4) OR (metric_name = 'r2' AND value < 0.7)""")
def dq20(spark, root):
    return op.metric_violations(fx.scored_metrics(spark, root)).select("event_id", "metric_name", "threshold", "direction")


@query("dq21_clean_levels", ctes("segments") + f"""SELECT event_id, least(greatest(level / 2.0::DOUBLE - 0.2, 0.0::DOUBLE), 1.0::DOUBLE) AS level,
    CASE WHEN event_id % 2 = 1 AND hour({TS}) BETWEEN 8 AND 19 THEN 1 ELSE 0 END::BIGINT AS regulated_hours FROM segments""")
def dq21(spark, root):
    s = fx.segments(spark, root).select("event_id", (F.col("level") / 2 - 0.2).alias("level"), (F.col("event_id") % 2).alias("regulated_hours"), "timestamp")
    return repair.clean_levels(s, "level", "regulated_hours", "timestamp").drop("timestamp")


@query("dq22_outlier_labels", ctes("obs_weather") + """SELECT event_id, occupancy = 0 OR raw_value > 100 AS is_outlier,
    temperature > (SELECT quantile_cont(temperature, 0.95) FROM obs_weather) OR precipitation > (SELECT quantile_cont(precipitation, 0.95) FROM obs_weather) AS extreme_weather FROM obs_weather""")
def dq22(spark, root):
    return op.outlier_labels(fx.obs_weather(spark, root), "raw_value", "temperature", "precipitation").select("event_id", "is_outlier", "extreme_weather")
