"""Edge rules of the operators with literal expected rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, stats
from tidemark.operators import aggs, correlation, drift, evaluation, features, joins, learning, monitoring, quality, repair, shaping, udf, windows
from tidemark.sources import readers, writers


def column(df, name):
    return [r[name] for r in df.collect()]


def test_single_point_distance_golden_values(spark):
    # 7 of 100 ones, a constant, and 52 of 100 values above the mean
    rows = [(1.0 if i < 7 else 0.0, 1.0, float(i % 25)) for i in range(100)]
    df = spark.createDataFrame(rows, "rare double, fixed double, ramp double")
    got = {r["feature"]: (round(r["ks_statistic"], 3), round(r["p_value"], 3)) for r in drift.numeric_drift(df, drift.baseline_profile(df, df.columns)).collect()}
    assert got["rare"] == (0.93, 0.158)
    assert got["fixed"] == (0.0, 1.0)
    assert got["ramp"] == (0.48, 1.0)


def test_corrected_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9)], "v double")
    n = F.count("v").cast("double")
    r = df.agg(windows.corrected_skew(n, F.skewness("v")).alias("s"), windows.corrected_kurtosis(n, F.kurtosis("v")).alias("k")).first()
    assert round(r["s"], 5) == 1.33094 and round(r["k"], 6) == 1.5


def test_time_interpolation_ends(spark):
    days, vals = (1, 2, 3, 5, 6), (None, 1.0, None, 3.0, None)
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, d), v) for d, v in zip(days, vals)], "k string, t timestamp, v double")
    got = column(windows.interpolate(df, ["k"], "t", ["v"]).orderBy("t"), "v")
    assert got[0] is None and got[1] == 1.0 and math.isclose(got[2], 1 + 2 / 3) and got[3:] == [3.0, 3.0]


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (26.0,), (100.0,), (101.0,)], "v double")
    assert column(df.select(joins.match_quality(F.col("v")).alias("q")), "q") == [None, "Excellent", "Good", "Fair", "Poor"]


def test_trailing_day_frame_is_open_on_the_left(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, d), float(d)) for d in (1, 2, 3)], "k string, t timestamp, v double")
    got = windows.rolling_moments(df, ["k"], "t", "v").orderBy("t")
    assert column(got, "mean") == [1.0, 2.0, 3.0] and column(got, "count") == [1, 1, 1]


def test_ewm_golden_values(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, d), float(d)) for d in (1, 2, 3)], "k string, t timestamp, v double")
    got = windows.ewm(df, ["k"], "t", "v").orderBy("t").collect()
    assert [round(r["ewm_mean"], 6) for r in got] == [1.0, 1.526316, 2.070111]
    assert got[0]["ewm_std"] is None and [round(r["ewm_std"], 6) for r in got[1:]] == [0.707107, 0.999077]


def test_quantile_bins_drop_duplicate_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 12 + list(range(1, 9))], "v double")
    want = pd.qcut(pd.Series([0.0] * 12 + [float(v) for v in range(1, 9)]), 10, duplicates="drop").cat.codes.tolist()
    assert column(aggs.quantile_bins(df, "v", 10), "bin") == want


def test_width_bins_match_pandas(spark):
    vals = [0.0, 1.0, 2.5, 5.0, 7.5, 9.999, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert column(aggs.width_bins(df, "v", 10), "bin") == pd.cut(pd.Series(vals), bins=10).cat.codes.tolist()


def test_smoothing_pads_with_zeros(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, i + 1), v) for i, v in enumerate([3.0, 6.0, 9.0, 3.0])], "k string, t timestamp, v double")
    for w in (3, 4):
        got = column(windows.moving_average(df, ["k"], "t", "v", w).orderBy("t"), "smoothed")
        np.testing.assert_allclose(got, np.convolve([3.0, 6.0, 9.0, 3.0], np.ones(w) / w, mode="same"))


def test_tail_probabilities():
    assert math.isclose(stats.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.chi2_sf(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.f_sf(4.964602743730711, 1, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.beta_quantile(0.025, 5, 6), 0.1870860284, rel_tol=1e-8)
    assert math.isclose(stats.beta_quantile(0.975, 6, 5), 0.8129139716, rel_tol=1e-8)


def test_column_tails(spark):
    df = spark.createDataFrame([(1.3581,), (0.1,), (-1.959963984540054,)], "x double")
    got = df.select(stats.kolmogorov_sf(F.col("x")).alias("k"), stats.normal_cdf(F.col("x")).alias("n")).collect()
    assert round(got[0]["k"], 4) == 0.05 and got[1]["k"] == 1.0 and abs(got[2]["n"] - 0.025) < 1e-7


def test_exact_interval_of_a_share(spark):
    df = spark.createDataFrame([("a", 1 if i < 5 else 0) for i in range(10)] + [("b", 1)] * 4, "k string, v int")
    got = {r["k"]: r for r in correlation.utilization_interval(df, ["k"], "v").collect()}
    assert round(got["a"]["ci_low"], 6) == 0.187086 and round(got["a"]["ci_high"], 6) == 0.812914
    assert got["b"]["ci_low"] is None and got["b"]["utilization_rate"] == 1.0


def test_rank_tests_have_the_known_p_values(spark):
    # two groups of ranks 1..5 and 6..10: U = 0
    df = spark.createDataFrame([("a" if i < 5 else "b", float(i)) for i in range(10)], "g string, v double")
    mw = correlation.mann_whitney(df, "g", "a", "b", "v").first()
    assert mw["u_statistic"] == 0.0 and round(mw["p_value"], 5) == 0.01219
    kw = correlation.kruskal_wallis(df, F.col("g"), "v").first()
    assert round(kw["h_statistic"], 6) == 6.818182 and round(kw["p_value"], 6) == 0.009023


def test_anova_p_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    r = correlation.anova(df, ["g"], "v").first()
    assert math.isclose(r["f_statistic"], 1.5) and round(r["p_value"], 4) == 0.2879 and r["max_diff"] == 1.0


def test_validator_reasons(spark):
    df = spark.createDataFrame(
        [(1, 0.5, "Loc-1", "2024-01-01 10:00:00", 10, 5), (2, 1.2, "bad id!", "2024-02-31", 0, -1), (3, None, None, None, None, None), (4, 0.5, "P-2", "2024-01-01T10:00:00Z", 10, 11)],
        "id int, occupancy_rate double, location_id string, timestamp string, total_spots int, available_spots int")
    got = {r["id"]: r["reasons"] for r in quality.validate(df, "raw").collect()}
    assert got[1] == []
    assert got[2] == ["invalid_occupancy_rate", "invalid_location_id", "invalid_timestamp", "invalid_total_spots", "invalid_available_spots", "inconsistent_occupancy_calculation"]
    assert got[3] == ["invalid_occupancy_rate", "invalid_location_id", "invalid_timestamp", "invalid_total_spots", "invalid_available_spots"]
    assert got[4] == ["invalid_available_spots", "inconsistent_occupancy_calculation"]


def test_validator_names_missing_columns(spark):
    df = spark.createDataFrame([(0.5, "a")], "occupancy_rate double, location_id string")
    assert quality.validate(df, "prediction").first()["reasons"] == [
        "missing_column_predicted_occupancy", "missing_column_prediction_timestamp", "missing_column_predicted_for_timestamp", "missing_column_model_version"]


@pytest.mark.parametrize(("text", "ok"), [("2024-01-05 06:07:08", True), ("2024-01-05 06:07:08.123456", True), ("2024-01-05T06:07:08", True),
                                          ("2024-01-05T06:07:08Z", True), ("2024-01-05", True), ("05/01/2024", False), ("2024-13-01", False), ("", False)])
def test_time_formats(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(rules.valid_time(F.col("t")).alias("ok")).first()["ok"] is ok


def test_raw_repair_keeps_the_step_order(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.4, 10, 4, "2024-01-01"), (2, "a", 0.5, None, 3, "2024-01-03"), (3, "a", None, 30, None, "x"), (4, None, 0.2, 0, 50, None), (5, "b", 0.3, 20, 25, "2024-01-02")],
        "id int, location_id string, occupancy_rate double, total_spots int, available_spots int, timestamp string")
    got = {r["id"]: r for r in repair.fix_raw(df).collect()}
    assert math.isclose(got[1]["occupancy_rate"], 0.6)  # recomputed from the spots
    assert got[2]["total_spots"] == 20.0  # median of its location
    assert got[3]["available_spots"] == round(30 * (1 - 0.4)) and got[3]["timestamp"] == dt.datetime(2024, 1, 2)
    assert got[4]["total_spots"] == 20.0 and got[4]["available_spots"] == 20.0 and got[4]["occupancy_rate"] == 0.0
    assert got[5]["available_spots"] == 20.0 and got[5]["occupancy_rate"] == 0.0


def test_prediction_repair(spark):
    df = spark.createDataFrame([(1, 1.5, None, None, None), (2, 0.5, "2024-01-01 00:00:00", "bad", "v2"), (3, None, "2024-01-02 00:00:00", "2024-01-02 05:00:00", "v2")],
                               "id int, predicted_occupancy double, prediction_timestamp string, predicted_for_timestamp string, model_version string")
    got = {r["id"]: r for r in repair.fix_predictions(df, "2024-02-01 00:00:00").collect()}
    assert got[1]["predicted_for_timestamp"] == dt.datetime(2024, 2, 1, 1) and got[1]["model_version"] == "v2" and got[1]["confidence"] == pytest.approx(0.7)
    assert got[2]["predicted_for_timestamp"] == dt.datetime(2024, 1, 1, 1) and got[2]["confidence"] == pytest.approx(0.95)
    assert got[3]["predicted_occupancy"] == 0.75


def test_mode_takes_the_lowest_on_a_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "w string")
    assert repair.mode_of(df, "w").first()["m"] == "a"


def test_pair_and_tariff_parsing(spark):
    df = spark.createDataFrame([("2.17,41.38",), ("[1.5, 2]",), ("x,1",), ("7",), (None,)], "s string")
    lon, lat = shaping.parse_pair(F.col("s"))
    assert [tuple(r) for r in df.select(lon, lat).collect()] == [(2.17, 41.38), (1.5, 2.0), (None, None), (None, None), (None, None)]
    t = spark.createDataFrame([("2,50 E/h <= 2h",), ("3",), ("free",)], "s string")
    assert column(t.select(shaping.tariff_number(F.col("s")).alias("n")), "n") == [2.5, 3.0, None]


def test_require_names_the_problem(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert shaping.require(df, ["a"], {"a": "int"}) is df
    with pytest.raises(ValueError, match="missing columns"):
        shaping.require(df, ["b"])


def test_label_codes_follow_sorted_order(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("c",), ("a",)], "w string")
    assert sorted((r["w"] or "", r["c"]) for r in features.label_codes(df, "w", "c").collect()) == [("", -1), ("a", 0), ("a", 0), ("b", 1), ("c", 2)]


def test_severity_bands(spark):
    df = spark.createDataFrame([(1.05, 1.0), (1.2, 1.0), (1.4, 1.0), (2.0, 1.0), (0.5, 1.0), (1.0, 0.0)], "v double, t double")
    out = evaluation.threshold_violations(df, "v", "t", ">")
    assert column(out, "severity") == ["LOW", "MEDIUM", "HIGH", "CRITICAL", "LOW", "CRITICAL"]
    with pytest.raises(ValueError):
        evaluation.threshold_violations(df, "v", "t", "~")


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y, w = rng.normal(size=200) * 5, rng.uniform(1, 3, 200)
    p = y + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"actual": y, "predicted": p, "w": w}))
    r = evaluation.regression_metrics(df, weight="w", names=["rmse", "mae", "r2", "mape"]).first()
    assert math.isclose(r["rmse"], math.sqrt(np.average((y - p) ** 2, weights=w)), rel_tol=1e-9)
    assert math.isclose(r["mae"], np.average(np.abs(y - p), weights=w), rel_tol=1e-9)
    want = 1 - np.sum(w * (y - p) ** 2) / np.sum(w * (y - np.average(y, weights=w)) ** 2)
    assert math.isclose(r["r2"], want, rel_tol=1e-9)
    assert math.isclose(r["mape"], np.mean(np.abs((y - p) / y)) * 100, rel_tol=1e-9)


def test_bootstrap_interval_agrees_with_the_normal_one(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"id": range(4000), "actual": e, "predicted": 0.0}))
    got = {r["metric"]: (r["ci_low"], r["ci_high"]) for r in evaluation.bootstrap_interval(df, ["id"], replicates=400).collect()}
    a = np.abs(e)
    half = 1.96 * a.std() / math.sqrt(len(a))
    assert abs(got["mae"][0] - (a.mean() - half)) < 0.004 and abs(got["mae"][1] - (a.mean() + half)) < 0.004
    again = {r["metric"]: (r["ci_low"], r["ci_high"]) for r in evaluation.bootstrap_interval(df.repartition(3), ["id"], replicates=400).collect()}
    np.testing.assert_allclose(got["rmse"], again["rmse"], rtol=1e-9)


def next_window(dom, dow, hour, minute, now):
    """Earliest calendar match strictly after `now`, minute by minute over days."""
    day = now.replace(hour=0, minute=0)
    for i in range(80):
        at = day + dt.timedelta(days=i, hours=hour, minutes=minute)
        if at > now and (at.day == dom if dom is not None else at.weekday() == dow):
            return at
    return None


def test_retraining_windows_match_a_calendar_walk(spark):
    rng = random.Random(4)
    for now in (dt.datetime(2024, 1, 15, 10, 30), dt.datetime(2024, 12, 28, 23, 0), dt.datetime(2024, 2, 29, 0, 0)):
        rows = []
        for i in range(40):
            dom, dow = (rng.randrange(1, 29), None) if i % 2 else (None, rng.randrange(7))
            rows.append((f"m{i}", dom, dow, rng.choice([0, 10, 23]), rng.choice([0, 30]), now - dt.timedelta(days=3)))
        df = spark.createDataFrame(rows, "model_id string, day_of_month int, day_of_week int, hour int, minute int, last_trained timestamp")
        got = {r["model_id"]: r for r in monitoring.retraining_due(df, now.isoformat(sep=" ")).collect()}
        for m, dom, dow, h, mi, _ in rows:
            assert got[m]["next_window"] == next_window(dom, dow, h, mi, now), (m, dom, dow, h, mi, now)
            hit = (now.day == dom if dom is not None else now.weekday() == dow) and (now.hour, now.minute) == (h, mi)
            assert got[m]["is_due"] is hit


def test_interval_schedule(spark):
    now = dt.datetime(2024, 1, 15, 10, 30)
    df = spark.createDataFrame([("old", None, None, None, None, now - dt.timedelta(days=31)), ("new", None, None, None, None, now - dt.timedelta(days=29, hours=23))],
                               "model_id string, day_of_month int, day_of_week int, hour int, minute int, last_trained timestamp")
    got = {r["model_id"]: r for r in monitoring.retraining_due(df, str(now)).collect()}
    assert got["old"]["is_due"] and got["old"]["next_window"] == now
    assert not got["new"]["is_due"] and got["new"]["next_window"] == now + dt.timedelta(hours=1)


def test_acknowledged_alerts_are_not_active(spark):
    df = spark.createDataFrame([("m1", "rmse", 2.0, dt.datetime(2024, 1, 1)), ("m1", "r2", 0.9, dt.datetime(2024, 1, 1)), ("m2", "r2", 0.1, dt.datetime(2024, 1, 2))],
                               "model_id string, metric_name string, value double, timestamp timestamp")
    a = monitoring.alerts(df, "performance")
    ids = sorted(column(a, "id"))
    assert len(ids) == 2
    assert monitoring.active_alerts(monitoring.acknowledge(a, [ids[0]])).count() == 1
    assert monitoring.active_alerts(a, model_id="m2").count() == 1
    assert monitoring.active_alerts(a, severity="critical").count() == 0


def test_linear_by_key_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i % 3}", *map(float, rng.normal(size=2) + 100)) for i in range(300)]
    rows = [(k, a, b, 2 * a - 3 * b + 7 + float(rng.normal()) * 0.1) for k, a, b in rows]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    got = {r["k"]: [r["intercept"], *r["coefficients"]] for r in learning.linear_by_key(df, "k", ["a", "b"], "y").collect()}
    for k in ("k0", "k1", "k2"):
        x = np.array([[1, r[1], r[2]] for r in rows if r[0] == k])
        want = np.linalg.lstsq(x, np.array([r[3] for r in rows if r[0] == k]), rcond=None)[0]
        np.testing.assert_allclose(got[k], want, rtol=1e-6)


def test_permutation_keeps_the_values(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "id long, v double")
    out = learning.shuffled(df, "v", "id")
    assert sorted(column(out, "v")) == [float(i) for i in range(50)] and out.where("v != id").count() > 30


def test_unknown_metric_is_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "actual double, predicted double")
    with pytest.raises(ValueError):
        evaluation.regression_metrics(df, names=["nope"])
    udf.register_sum_metric("over", lambda y, p: (p > y).cast("double"))
    assert udf.evaluate(df, ["over"]).first()["over"] == 1.0 and "over" in udf.registered()


def test_backup_is_verified(spark, tmp_path):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 2, i % 24)) for i in range(60)], "id int, timestamp timestamp")
    out = writers.backup(df, str(tmp_path / "b"))
    assert out.where("verified").agg(F.sum("rows")).first()[0] == 60 and out.where("NOT verified").count() == 0


def test_csv_date_stands_in_for_timestamp(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event_id,location_id,timestamp,date,occupancy,capacity\n1,a,2024-01-01 05:00:00,,1.5,10\n2,a,,2024-01-02,2.5,10\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("event_id").collect()
    assert [r["timestamp"] for r in got] == [dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 2)]


def test_poisson_draws_equal_the_search_in_the_distribution():
    u = np.concatenate([np.random.default_rng(1).integers(0, 1 << 53, 50_000, dtype="uint64"), evaluation._POISSON_53[:11], evaluation._POISSON_53[:11] + np.uint64(1), np.array([0, (1 << 53) - 1], "uint64")])
    want = np.searchsorted(evaluation._POISSON, u.astype("float64") / float(1 << 53))
    assert evaluation._draws(u.reshape(2, -1)).ravel().tolist() == want.tolist() and want.max() > 8


def test_one_order_shuffles_all_columns(spark, monkeypatch):
    """The order of the rows is found once, not per column; each column is the one `shuffled` gives."""
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(50)], "id long, a double, b double")
    both = {r["id"]: (r["__new_a"], r["__new_b"]) for r in learning.with_shuffled(df, ["a", "b"], "id").collect()}
    assert {k: v[0] for k, v in both.items()} == {r["id"]: r["a"] for r in learning.shuffled(df, "a", "id").collect()}
    assert sorted(v[0] for v in both.values()) == sorted(float(i) for i in range(50)) and all(a == -b for a, b in both.values()) and any(k != v[0] for k, v in both.items())
    seen, codes = [], learning.sorted_codes
    monkeypatch.setattr(learning, "sorted_codes", lambda *a: seen.append(a) or codes(*a))
    model = learning.fit(df.withColumn("y", F.col("a") * 2), "linear", ["a", "b"], [], "y")
    out = learning.permutation_importance(model, df.withColumn("y", F.col("a") * 2), ["a", "b"], "id", "y").collect()
    assert len(out) == 2 and len(seen) == 2
