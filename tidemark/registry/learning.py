"""Queries of the model family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.functions import calendar
from tidemark.operators import boosting, joins
from tidemark.operators import learning as op
from tidemark.operators.evaluation import fold_summary, regression_metrics
from tidemark.registry import joins as jn
from tidemark.registry.core import query
from tidemark.registry.features import (
    DOWNTOWN, FACTOR_SQL, H, HM, TRAFFIC_SQL, TS, WD, WE, pattern_sql,
)
from tidemark.session import cut

NUMERIC = ["hour", "weekday", "is_weekend", "capacity", "temperature", "humidity", "wind_speed", "precipitation"]
CATEGORICAL = ["parking_type", "location_id"]
LABEL = "demand"


def frame(spark, root):
    """Rows with features and a label that depends on hour, weekend and weather."""
    o = fx.obs_weather(spark, root)
    ts = F.col("timestamp")
    label = F.col("occupancy") * 0.2 + calendar.hours(ts) * 2 + F.when(calendar.is_weekend(ts), 10.0).otherwise(0.0) + F.col("humidity") * 0.1
    return o.withColumns({"hour": F.hour(ts).cast("double"), "weekday": F.weekday(ts).cast("double"),
                          "is_weekend": calendar.is_weekend(ts).cast("double"), LABEL: label})


FRAME = f"""fr AS (SELECT *, {H}::DOUBLE AS hour, {WD}::DOUBLE AS weekday, occupancy * 0.2 + {HM} * 2 + CASE WHEN {WE} THEN 10.0 ELSE 0.0 END + humidity * 0.1 AS demand,
    event_id % 10 < 8 AS is_train FROM obs_weather)"""


def split(spark, root):
    s = op.hash_split(frame(spark, root), ["event_id"])
    return s.where("is_train").drop("is_train"), s.where("NOT is_train").drop("is_train")


def evaluated(df, label=LABEL):
    return regression_metrics(df, actual=label, names=["rmse", "mae", "r2"])


@query("ml1_preprocess")
def ml1(spark, root):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    f = frame(spark, root)
    p = Pipeline(stages=op.preprocessing(NUMERIC, CATEGORICAL)).fit(f).transform(f)
    v = vector_to_array(op.FEATURES)
    return p.select("event_id", F.size(v).cast("bigint").alias("width"), v[0].alias("hour_scaled"), v[3].alias("capacity_scaled"))


@query("ml1_standardised", ctes("obs_weather", extra=FRAME) + "SELECT event_id, round((hour - avg(hour) OVER ()) / stddev_samp(hour) OVER (), 6) + 0.0 AS hour_scaled, round((capacity - avg(capacity) OVER ()) / stddev_samp(capacity) OVER (), 6) + 0.0 AS capacity_scaled FROM fr")
def ml1b(spark, root):
    return ml1(spark, root).select("event_id", "hour_scaled", "capacity_scaled")


@query("ml2_hash_split")
def ml2(spark, root):
    s = op.hash_split(fx.obs(spark, root), ["event_id"])
    return s.groupBy("is_train").agg(F.count(F.lit(1)).alias("rows"))


@query("ml3_time_folds", ctes("obs") + f"""SELECT event_id, CASE WHEN p >= n - 5 * (n // 6) THEN (p - (n - 5 * (n // 6))) // (n // 6) END AS fold FROM (
    SELECT event_id, row_number() OVER (ORDER BY {TS}, event_id) - 1 AS p, count(*) OVER () AS n FROM obs)""")
def ml3(spark, root):
    return op.time_folds(fx.obs(spark, root), "timestamp", ["event_id"], 5).select("event_id", "fold")


@query("ml4_gbt")
def ml4a(spark, root):
    train, test = split(spark, root)
    return evaluated(op.predict(op.fit(train, "gbt", NUMERIC, CATEGORICAL, LABEL), test))


@query("ml4_random_forest")
def ml4b(spark, root):
    train, test = split(spark, root)
    return evaluated(op.predict(op.fit(train, "forest", NUMERIC, CATEGORICAL, LABEL), test))


@query("ml5_linear_family")
def ml5(spark, root):
    train, test = split(spark, root)
    out = None
    for kind in ("linear", "ridge", "lasso", "elastic_net"):
        one = evaluated(op.predict(op.fit(train, kind, NUMERIC, CATEGORICAL, LABEL), test)).withColumn("model", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("ml6_linear_by_location", ctes("obs_weather", extra=FRAME) + """SELECT location_id, count(*) AS n, round(regr_intercept(demand, hour), 5) AS intercept, round(regr_slope(demand, hour), 5) AS slope FROM fr GROUP BY 1 HAVING count(*) >= 50""", digits=5)
def ml6(spark, root):
    m = op.linear_by_key(frame(spark, root), "location_id", ["hour"], LABEL)
    return m.select("location_id", "n", "intercept", F.col("coefficients")[0].alias("slope"))


@query("ml6_scored_by_location")
def ml6b(spark, root):
    f = frame(spark, root)
    cols = ["hour", "is_weekend", "humidity", "temperature"]
    return regression_metrics(op.score_linear(f, op.linear_by_key(f, "location_id", cols, LABEL), "location_id", cols), ["location_id"], LABEL, names=["rmse", "r2"])


def held_out(df):
    """The split of the other model queries as one fold."""
    return op.hash_split(df, ["event_id"]).withColumn("fold", F.when(~F.col("is_train"), 0)).drop("is_train")


@query("ml6_pipelines_by_group")
def ml6c(spark, root):
    """100 stages for every parking type."""
    p = boosting.boosted(held_out(frame(spark, root)), "parking_type", NUMERIC, [], LABEL, ["event_id"], 1)
    return boosting.fold_report(p, "parking_type").select("parking_type", "rows", "rmse", "mae", "r2")


@query("ml6_boosted_by_location")
def ml6d(spark, root):
    """100 stages for every location with 50 rows or more, all side by side."""
    p = boosting.boosted(held_out(frame(spark, root)), "location_id", NUMERIC, ["parking_type"], LABEL, ["event_id"], 1)
    return boosting.fold_report(p, "location_id").select("location_id", "rows", "rmse", "mae", "r2")


@query("ml7_cross_validation_by_location")
def ml7b(spark, root):
    """Five expanding folds and 100 stages for every location."""
    folded = op.time_folds(frame(spark, root), "timestamp", ["event_id"], 5, "location_id")
    return boosting.fold_report(boosting.boosted(folded, "location_id", NUMERIC, ["parking_type"], LABEL, ["event_id"], 5), "location_id")


@query("ml7_cross_validation")
def ml7(spark, root):
    folded = op.time_folds(frame(spark, root), "timestamp", ["event_id"], 5)
    # read three times
    return fold_summary(cut(boosting.boosted(folded, None, NUMERIC, CATEGORICAL, LABEL, ["event_id"], 5)), actual="actual")


@query("ml8_random_search")
def ml8(spark, root):
    """50 candidates of 50 to 499 trees over five expanding folds."""
    folded = op.time_folds(frame(spark, root), "timestamp", ["event_id"], 5)
    return boosting.searched(folded, None, NUMERIC, CATEGORICAL, LABEL, ["event_id"], 5, boosting.random_candidates(50))


@query("ml9_impurity_importance")
def ml9a(spark, root):
    train, _ = split(spark, root)
    return op.impurity_importance(op.fit(train, "forest", NUMERIC, ["parking_type"], LABEL), train)


@query("ml9_permutation_importance")
def ml9b(spark, root):
    train, test = split(spark, root)
    m = op.fit(train, "gbt", NUMERIC, [], LABEL)
    return op.permutation_importance(m, test, NUMERIC, "event_id", LABEL)


@query("ml10_batch_scoring", ctes("obs_weather", extra=FRAME + ", " + jn.REGISTRY) + """, m AS (
    SELECT r.model_id, regr_intercept(demand, hour) AS i, regr_slope(demand, hour) AS s FROM fr JOIN r USING (location_id) GROUP BY 1 HAVING count(*) >= 50
    UNION ALL SELECT 'model_global', regr_intercept(demand, hour), regr_slope(demand, hour) FROM fr HAVING count(*) >= 50),
    p AS (SELECT coalesce(r.model_id, 'model_global') AS model_id, CASE WHEN r.model_id IS NULL THEN 'global' ELSE 'location' END AS route, hour FROM fr LEFT JOIN r USING (location_id))
    SELECT model_id, route, count(*) AS rows, count(i + s * hour) AS scored, count(*) - count(i + s * hour) AS errors, round(avg(i + s * hour), 5) AS mean_predicted
    FROM p LEFT JOIN m USING (model_id) GROUP BY 1, 2""", digits=5)
def ml10(spark, root):
    f, known = frame(spark, root), jn.registry(spark, root)
    own = op.linear_by_key(f, "location_id", ["hour"], LABEL).join(known, "location_id").select("model_id", "intercept", "coefficients")
    world = op.linear_by_key(f.withColumn("model_id", F.lit("model_global")), "model_id", ["hour"], LABEL).select("model_id", "intercept", "coefficients")
    scored = op.score_registered(joins.route_models(f, known), own.unionByName(world), ["hour"])
    return scored.groupBy("model_id", "route").agg(
        F.count(F.lit(1)).alias("rows"), F.count("predicted").alias("scored"), F.count("error").alias("errors"), F.avg("predicted").alias("mean_predicted"))


@query("ml11_compare_and_ensemble")
def ml11(spark, root):
    train, test = split(spark, root)
    kinds = dict.fromkeys(("gbt", "forest", "linear", "ridge", "lasso", "elastic_net"), {})
    return op.compare_regressors(train, test, kinds, NUMERIC, CATEGORICAL, LABEL, ["event_id"])


CONFIGS = [{"weights": {"time_pattern": 0.5, "traffic_sensitivity": 0.4, "zone_influence": 0.3, "weather_impact": 0.2, "capacity_factor": 0.2}, "share": 2.0},
           {"weights": {"time_pattern": 0.3, "traffic_sensitivity": 0.2, "zone_influence": 0.1, "weather_impact": 0.6, "capacity_factor": 0.4}, "share": 1.0}]
PART = {"time_pattern": f"(CASE kind WHEN 'Resident' THEN {pattern_sql('Resident')} ELSE {pattern_sql('Public')} END * 100)", "traffic_sensitivity": f"({TRAFFIC_SQL} * (0.3 + 0.7 * {DOWNTOWN}))",
        "zone_influence": f"({DOWNTOWN} + 1 - 0.7 * {DOWNTOWN})", "weather_impact": FACTOR_SQL, "capacity_factor": "least(1.0, capacity / 500.0)"}
MIX = " + ".join(f"{c['share'] / 3}::DOUBLE * least(greatest({' + '.join(f'{w} * {PART[n]}' for n, w in c['weights'].items())}, 0.0), 100.0)" for c in CONFIGS)


@query("ml12_rule_ensemble", ctes("obs_weather", extra="""k AS (SELECT *, CASE WHEN parking_type = 'Mixed' THEN CASE WHEN avg(occupancy) OVER (PARTITION BY location_id) > 0.6 THEN 'Public' ELSE 'Resident' END ELSE parking_type END AS kind FROM obs_weather)""") + f"""
    , p AS (SELECT location_id, occupancy AS actual, {MIX} AS predicted FROM k WHERE {TS} >= TIMESTAMP '2024-01-16 00:00:00')
    SELECT location_id, round(sqrt(avg(pow(actual - predicted, 2))), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae,
    round(1 - sum(pow(actual - predicted, 2)) / (sum(actual * actual) - pow(sum(actual), 2) / count(*)), 6) AS r2, count(*) AS sample_size FROM p GROUP BY 1""")
def ml12(spark, root):
    return op.rule_ensemble(fx.obs_weather(spark, root), CONFIGS, "2024-01-16 00:00:00")


@query("ml13_stacking")
def ml13(spark, root):
    train, test = split(spark, root)
    return evaluated(op.stack(train, test, {"gbt": {"maxIter": 5}, "linear": {}}, NUMERIC, [], LABEL, ["event_id"], folds=2, maxIter=5))


def _screen(c):
    return f"""SELECT '{c}' AS variable, coefficient, sqrt(avg(pow(demand - a - coefficient * x, 2))) AS rmse, 1 - sum(pow(demand - a - coefficient * x, 2)) / (sum(demand * demand) - pow(sum(demand), 2) / count(*)) AS r2
    FROM (SELECT {c} AS x, demand FROM fr WHERE NOT is_train), (SELECT regr_slope(demand, {c}) AS coefficient, regr_intercept(demand, {c}) AS a FROM fr WHERE is_train) GROUP BY coefficient"""


@query("ml14_screen_variables", ctes("obs_weather", extra=FRAME) + "SELECT variable, round(coefficient, 5) + 0.0 AS coefficient, round(rmse, 5) AS rmse, round(r2, 5) + 0.0 AS r2 FROM (" + " UNION ALL ".join(_screen(c) for c in ("hour", "humidity", "temperature")) + ")", digits=5)
def ml14(spark, root):
    return op.screen_numeric(frame(spark, root), ["hour", "humidity", "temperature"], LABEL, F.col("event_id") % 10 < 8)


@query("ml14_screen_categories", ctes("obs_weather", extra=FRAME) + """, m AS (SELECT location_id, avg(demand) AS m FROM fr WHERE is_train GROUP BY 1), p AS (SELECT demand AS y, coalesce(m, (SELECT avg(demand) FROM fr WHERE is_train)) AS p
    FROM fr LEFT JOIN m USING (location_id) WHERE NOT is_train) SELECT 'location_id' AS variable, round(sqrt(avg(pow(y - p, 2))), 5) AS rmse, round(1 - sum(pow(y - p, 2)) / (sum(y * y) - pow(sum(y), 2) / count(*)), 5) + 0.0 AS r2 FROM p""", digits=5)
def ml14b(spark, root):
    return op.screen_categories(frame(spark, root), ["location_id"], LABEL, F.col("event_id") % 10 < 8)


@query("ml15_screen_groups")
def ml15(spark, root):
    train, test = split(spark, root)
    groups = {"time": (["hour", "weekday", "is_weekend"], []), "weather": (["temperature", "humidity", "wind_speed", "precipitation"], []), "place": (["capacity"], ["parking_type"])}
    return op.screen_groups(train, test, groups, LABEL)


@query("ml16_geo_clusters")
def ml16(spark, root):
    c = op.geo_clusters(fx.points(spark, root), k=5)
    return c.groupBy("location_cluster").agg(F.count(F.lit(1)).alias("points"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
