"""Literal values for repaired faults: doubled rows, overflow, radii, strengths."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, joins, learning, maintenance
from tidemark.operators.correlation import kendall
from tidemark.plans import ordered
from tidemark.session import shared_dir

T0 = dt.datetime(2024, 1, 1, 12)


def test_two_models_of_a_location_do_not_double_rows(spark):
    obs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, location_id string")
    registry = spark.createDataFrame([("a", "m1"), ("a", "m2"), (None, "g")], "location_id string, model_id string")
    got = {r["id"]: (r["model_id"], r["route"]) for r in joins.route_models(obs, registry).collect()}
    assert got == {1: ("m2", "location"), 2: ("g", "global"), 3: ("g", "global")}


def test_newest_change_counts_and_columns_can_be_cleared(spark):
    table = spark.createDataFrame([(1, "x", 5.0), (2, "y", 6.0)], "id int, s string, v double")
    changes = spark.createDataFrame([(1, "old", None, 1, []), (1, "new", None, 2, ["v"])], "id int, s string, v double, at int, off array<string>")
    got = sorted(maintenance.update_by_id(table, changes, "id", "at", "off").collect())
    assert got == [(1, "new", None), (2, "y", 6.0)]
    put = maintenance.upsert(table, changes.select("id", "s", "v"), "id")
    assert sorted(r["id"] for r in put.collect()) == [1, 2]


def test_many_events_keep_a_finite_logarithm(spark):
    obs = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(days=9))], "id int, timestamp timestamp")
    events = spark.range(3000).select(F.lit(T0 - dt.timedelta(hours=1)).alias("start_time"), F.lit(T0 + dt.timedelta(hours=1)).alias("end_time"), F.lit(0.5).alias("impact_factor"))
    got = {r["id"]: r for r in joins.event_impact(obs, events).collect()}
    assert got[1]["log_impact"] == pytest.approx(3000 * math.log(1.5)) and got[2]["log_impact"] == 0 and got[2]["event_impact"] == 1


def test_radius_of_the_event(spark):
    obs = spark.createDataFrame([(1, T0, 41.0, 2.0)], "id int, timestamp timestamp, latitude double, longitude double")
    row = (T0, T0, 41.01, 2.0, 0.5)
    events = spark.createDataFrame([(*row, 10.0)], "start_time timestamp, end_time timestamp, event_lat double, event_lon double, impact_factor double, impact_radius double")
    near = joins.event_impact_near(obs, events).first()["event_impact"]
    default = joins.event_impact_near(obs, events.withColumn("impact_radius", F.lit(None).cast("double"))).first()["event_impact"]
    km = 2 * 6371 * math.asin(math.sin(math.radians(0.01) / 2))
    assert near == pytest.approx(1 + 0.5 * math.exp(-km / 10), rel=1e-3) and default == pytest.approx(1 + 0.5 * math.exp(-km / 2), rel=1e-3)


def test_kendall_beyond_the_range_of_a_long(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2)], "x int, y int")
    assert kendall(rows, "x", "y").first()["correlation"] == 1.0


def test_strengths_of_the_linear_family():
    assert [(m.getRegParam(), m.getElasticNetParam(), m.getStandardization()) for m in (learning.regressor(k, "y") for k in ("lasso", "elastic_net"))] == [(0.1, 1.0, False), (0.1, 0.5, False)]


def test_no_private_folder_off_local_mode(spark):
    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_dir(Far)
    assert shared_dir(spark)


def test_short_features_keep_their_row(spark):
    a = spark.createDataFrame([(float(i), 1.0 if i < 3 else None, 2.0) for i in range(40)], "x double, few double, gone double")
    b = spark.createDataFrame([(float(i + 20), 1.0, None) for i in range(40)], "x double, few double, gone double")
    got = {r["feature"]: r for r in drift.two_sample(a, b, ["x", "few", "gone"], 10).collect()}
    assert got["x"]["drift_score"] == 0.5 and got["x"]["is_drift_detected"]
    assert (got["few"]["n_reference"], got["few"]["drift_score"], got["few"]["p_value"], got["few"]["is_drift_detected"]) == (3, 0.0, None, None)
    assert (got["gone"]["n_current"], got["gone"]["drift_score"], got["gone"]["p_value"]) == (0, None, None)


def test_one_place_is_a_cluster(spark):
    df = spark.createDataFrame([(1, 41.0, 2.0), (2, 41.0, 2.0), (3, None, 2.0)], "id int, latitude double, longitude double")
    got = learning.geo_clusters(df)
    assert dict(got.dtypes)["location_cluster"] == "bigint"
    assert {r["id"]: r["location_cluster"] for r in got.collect()} == {1: 0, 2: 0, 3: -1}


def test_slices_grow_with_the_values(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 20)
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    assert ordered.sliced(df, "v").groupBy(ordered.SLICE).count().agg(F.max("count"), F.count("*")).first()[1] >= 45
    got = ordered.running(df, "v").where("v = 700").first()
    assert (got["n_below"], got["n_total"]) == (700, 1000)


def test_rows_are_scored_by_any_registered_model(spark):
    rows = spark.createDataFrame([(1, 2.0, "m1", None), (2, 2.0, "m2", None), (3, 2.0, None, "no model for c")], "id int, x double, model_id string, error string")
    models = spark.createDataFrame([("m1", 1.0, [3.0])], "model_id string, intercept double, coefficients array<double>")
    got = {r["id"]: (r["predicted"], r["error"]) for r in learning.score_registered(rows, models, ["x"]).collect()}
    assert got == {1: (7.0, None), 2: (None, "model not loaded: m2"), 3: (None, "no model for c")}
