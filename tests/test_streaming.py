"""Streams against the same rows in a batch."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import jobs

T0 = pd.Timestamp("2024-01-01")


def stream_of(spark, pdf, path, pieces):
    """The rows as consecutive files in time order."""
    pdf = pdf.sort_values("timestamp")
    size = -(-len(pdf) // pieces)
    for i in range(pieces):
        part = spark.createDataFrame(pdf.iloc[i * size:(i + 1) * size]).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(path)
    return jobs.read_files(spark, path, part.schema, 1)


def test_running_metrics_carry_state(spark, tmp_path):
    rng = random.Random(1)
    pdf = pd.DataFrame({"metric_name": [rng.choice("aab") for _ in range(90)], "value": [rng.random() for _ in range(90)],
                        "timestamp": [T0 + pd.Timedelta(minutes=3 * i) for i in range(90)]})
    out = jobs.drain(jobs.running_metrics(stream_of(spark, pdf, str(tmp_path / "in"), 3)), "running").toPandas()
    for name, g in pdf.groupby("metric_name"):
        rows = out[out["metric_name"] == name].sort_values("count")
        assert rows["count"].iloc[-1] == len(g) and rows["last_value"].iloc[-1] == g["value"].iloc[-1]
        assert pd.isna(rows["rate_of_change"].iloc[0])
        a, b = rows.iloc[-2], rows.iloc[-1]
        want = (b["last_value"] - a["last_value"]) / ((b["last_us"] - a["last_us"]) / 3.6e9)
        assert abs(b["rate_of_change"] - want) < 1e-9


def test_alert_throttle_matches_a_walk(spark, tmp_path):
    rng = random.Random(2)
    n = 400
    pdf = pd.DataFrame({"model_id": [rng.choice(["m1", "m1", "m2"]) for _ in range(n)], "metric_name": [rng.choice([f"x{i}" for i in range(14)]) for _ in range(n)],
                        "timestamp": [T0 + pd.Timedelta(seconds=20 * i) for i in range(n)], "current_value": [float(i) for i in range(n)]})
    kept = jobs.drain(jobs.throttle_alerts(stream_of(spark, pdf, str(tmp_path / "in"), 3)), "alerts").toPandas()
    last, sent, want = {}, {}, []
    for r in pdf.itertuples():
        us = int(r.timestamp.value // 1000)
        slot = (r.model_id, us // 3_600_000_000)
        if us - last.get((r.model_id, r.metric_name), -10**18) < 900_000_000 or sent.get(slot, 0) >= 10:
            continue
        last[(r.model_id, r.metric_name)] = us
        sent[slot] = sent.get(slot, 0) + 1
        want.append(r.current_value)
    assert sorted(kept["current_value"]) == want and len(want) < n


def log_of(n, seed=4):
    rng = random.Random(seed)
    return pd.DataFrame({"model_id": [rng.choice(["m1", "m2", None]) for _ in range(n)], "timestamp": [T0 + pd.Timedelta(seconds=37 * i) for i in range(n)],
                         "is_error": [rng.random() < 0.3 for _ in range(n)], "duration_ms": [float(rng.randrange(100)) for _ in range(n)]})


def rates_of(pdf):
    g = pdf.fillna({"model_id": "-"}).groupby([pdf["timestamp"].dt.floor("5min"), "model_id"])
    return {(t, m): (len(x), round(x["is_error"].mean(), 9), round(x["duration_ms"].mean(), 9)) for (t, m), x in g}


def stored_rates(table):
    return {(pd.Timestamp(r["window_start"]), r["model_id"] or "-"): (r["request_count"], round(r["error_rate"], 9), round(r["mean_latency_ms"], 9)) for r in table.read().collect()}


def test_open_windows_are_reported(spark, tmp_path):
    """The last window has not ended when the stream stops, and windows are cut by the files' ends."""
    pdf = log_of(300)
    stream = jobs.error_rates(stream_of(spark, pdf, str(tmp_path / "in"), 4))
    table = jobs.drain_windows(stream, "rates", ["window_start", "model_id"], str(tmp_path / "out"))
    assert stored_rates(table) == rates_of(pdf)
    assert max(t for t, _ in stored_rates(table)) + pd.Timedelta(minutes=5) > pdf["timestamp"].max()


def test_windows_go_on_after_a_stop_and_a_replayed_batch(spark, tmp_path):
    pdf = log_of(240)
    first, rest = pdf.iloc[:130], pdf.iloc[130:]
    out = str(tmp_path / "out")
    jobs.drain_windows(jobs.error_rates(stream_of(spark, first, str(tmp_path / "in"), 2)), "rates", ["window_start", "model_id"], out)
    stream = jobs.error_rates(stream_of(spark, rest, str(tmp_path / "in"), 2))
    table = jobs.drain_windows(stream, "rates", ["window_start", "model_id"], out)
    assert stored_rates(table) == rates_of(pdf)
    done = table.snapshot()["done"]["rates"]
    wrong = table.read().withColumn("request_count", F.lit(0).cast("bigint"))
    table.upsert(wrong, token=("rates", done))  # the last batch once more
    assert stored_rates(table) == rates_of(pdf)


def test_repeated_batch_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    jobs.write_batch(df, str(tmp_path / "t"), 0)
    jobs.write_batch(df, str(tmp_path / "t"), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_repair_finds_its_fills_once_and_spreads_its_batches(spark, tmp_path, monkeypatch):
    at, version, made = [None, 0.2, 0.4, 0.9], ["v2", None, "v1", "v2"], ("L", "2024-01-01 00:00:00", "2024-01-01 01:00:00")
    all_rows = [(i, at[i % 4], *made, version[i % 4]) for i in range(12)]
    for k in range(3):
        part = spark.createDataFrame(all_rows[4 * k:4 * k + 4], "record_id int, predicted_occupancy double, location_id string, prediction_timestamp string, predicted_for_timestamp string, model_version string")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = jobs.read_files(spark, str(tmp_path / "in"), part.schema, 1)
    monkeypatch.setattr(jobs, "TASK_ROWS", 1)
    known = spark.createDataFrame([(0.3, "v7"), (0.6, "v7"), (0.6, "v8")], "predicted_occupancy double, model_version string")
    medians, parts = [], []
    median_of, validate = jobs.repair.median_of, jobs.quality.validate
    monkeypatch.setattr(jobs.repair, "median_of", lambda *a: medians.append(a) or median_of(*a))
    monkeypatch.setattr(jobs.quality, "validate", lambda batch, kind: parts.append(batch.rdd.getNumPartitions()) or validate(batch, kind))
    jobs.validate_and_load(rows, "prediction", str(tmp_path / "good"), str(tmp_path / "bad"), fix=True, as_of="2024-02-01 00:00:00", known=known)
    got = {r["record_id"]: (r["predicted_occupancy"], r["model_version"]) for r in spark.read.parquet(str(tmp_path / "good")).collect()}
    assert got == {i: (0.6 if p is None else p, v or "v7") for i, p, *_, v in all_rows}
    assert len(medians) == 1 and parts == [min(4, spark.sparkContext.defaultParallelism)] * 3
