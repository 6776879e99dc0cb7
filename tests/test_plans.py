"""Shared plan shapes against brute force, with small blocks and hot keys so that every seam is crossed."""

from __future__ import annotations

import math
import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import windows as win
from tidemark.operators.correlation import kendall, spearman
from tidemark.plans import ordered, series, slices, spatial, timejoin
from tidemark.session import nan_to_null

T0 = pd.Timestamp("2024-01-01")


def events(n, seed=1, hot=0.6, minutes=60 * 24 * 6):
    """Irregular readings: one key holds most rows, values repeat, some times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(4)}"
        rows.append((i, key, T0 + pd.Timedelta(minutes=rng.randrange(minutes)), float(rng.randrange(40)) / 4))
    return pd.DataFrame(rows, columns=["id", "key", "t", "v"])


def frame(spark, pdf):
    return nan_to_null(spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("timestamp")))


@pytest.fixture(params=[slices.SLICE_ROWS, 40], ids=["whole", "sliced"])
def both(request, monkeypatch):
    """Keys that fit into a task, and keys cut into many slices."""
    monkeypatch.setattr(slices, "SLICE_ROWS", request.param)
    return request.param


def test_quantiles_match_numpy(spark):
    pdf = events(800)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.95, 1.0]
    got = {r["key"]: r for r in ordered.quantiles(frame(spark, pdf), "v", probs, ["key"]).collect()}
    for key, g in pdf.groupby("key"):
        assert got[key]["n"] == len(g)
        np.testing.assert_allclose(got[key]["q"], np.quantile(g["v"], probs), rtol=1e-12)
    whole = ordered.quantiles(frame(spark, pdf), "v", probs).first()["q"]
    np.testing.assert_allclose(whole, np.quantile(pdf["v"], probs), rtol=1e-12)


def test_quantiles_of_one_value_and_nulls(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", None), ("b", 1.0)], "key string, v double")
    got = {r["key"]: r["q"] for r in ordered.quantiles(df, "v", [0.25, 0.5], ["key"]).collect()}
    assert got == {"a": [3.0, 3.0], "b": [1.0, 1.0]}


def test_average_ranks_match_pandas(spark):
    pdf = events(500)
    r = {row["v"]: row["rank"] for row in ordered.average_ranks(frame(spark, pdf), "v").collect()}
    want = pdf["v"].rank()
    assert all(abs(r[v] - w) < 1e-9 for v, w in zip(pdf["v"], want))


def test_sorted_codes(spark):
    words = [f"w{i % 57:03d}" for i in range(400)]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = {r["w"]: r["c"] for r in ordered.sorted_codes(df, "w", "c").collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


@pytest.mark.parametrize("block", [None, 1, 3, 1000])
def test_row_frame_crosses_blocks(spark, block, both):
    pdf = events(300)
    out = series.row_frame(frame(spark, pdf), ["key"], "t", lambda w: {
        "lag2": F.lag("v", 2).over(w), "lead1": F.lead("v", 1).over(w), "s": F.sum("v").over(w.rowsBetween(-2, 1))}, ["id"], 2, 1, block_rows=block)
    got = out.orderBy("id").toPandas()
    o = pdf.sort_values(["key", "t", "id"])
    g = o.groupby("key")["v"]
    o["lag2"], o["lead1"] = g.shift(2), g.shift(-1)
    o["s"] = sum(g.shift(k).fillna(0) for k in (2, 1, 0, -1))
    o = o.sort_values("id")
    for c in ("lag2", "lead1", "s"):
        np.testing.assert_allclose(got[c].astype(float), o[c].astype(float), err_msg=c)
    assert len(got) == len(pdf)


def brute_frames(pdf, hours, closed=False):
    """Trailing frame of every row: (t - h, t] or [t - h, t], peers included."""
    out = {}
    span = pd.Timedelta(hours=hours)
    for _, g in pdf.groupby("key"):
        for r in g.itertuples():
            lo = g["t"] >= r.t - span if closed else g["t"] > r.t - span
            out[r.id] = g[lo & (g["t"] <= r.t)]
    return out


@pytest.mark.parametrize(("hours", "parts"), [(24, 1), (24, 24), (6, 3)])
def test_sliding_matches_brute_force(spark, hours, parts, both):
    pdf = events(400)
    out = series.sliding(frame(spark, pdf), ["key"], "t", hours * 3600, {"n": F.lit(1).cast("bigint"), "s": F.col("v")},
                         extremes={"lo": (F.col("v"), "min"), "hi": (F.col("v"), "max")}, firsts={"first_id": F.date_trunc("minute", "t")}, parts=parts)
    got = {r["id"]: r for r in out.collect()}
    want = brute_frames(pdf, hours)
    assert len(got) == len(pdf)
    for i, g in want.items():
        assert got[i]["n"] == len(g)
        assert math.isclose(got[i]["s"], g["v"].sum(), abs_tol=1e-9)
        assert (got[i]["lo"], got[i]["hi"]) == (g["v"].min(), g["v"].max())
        assert pd.Timestamp(got[i]["first_id"]) == g["t"].min()


def test_sliding_closed_interval(spark, both):
    pdf = events(300)
    out = series.sliding(frame(spark, pdf), ["key"], "t", 3600, {"n": F.lit(1).cast("bigint")}, open_left=False)
    want = brute_frames(pdf, 1, closed=True)
    assert {r["id"]: r["n"] for r in out.collect()} == {i: len(g) for i, g in want.items()}


def test_rolling_moments_match_pandas(spark, both):
    pdf = events(400).drop_duplicates(["key", "t"]).reset_index(drop=True)
    got = win.rolling_moments(frame(spark, pdf), ["key"], "t", "v").orderBy("id").toPandas().set_index("id")
    for _, g in pdf.sort_values("t").groupby("key"):
        r = g.set_index("t")["v"].rolling("24h", min_periods=1)
        for name, want in (("mean", r.mean()), ("std", r.std()), ("skew", r.skew()), ("kurtosis", r.kurt()), ("min", r.min()), ("max", r.max())):
            have = got.loc[g["id"], name].astype(float).to_numpy()
            want = want.to_numpy()
            spread = r.std().to_numpy() > 1e-6
            keep = spread | (name in ("mean", "min", "max"))
            np.testing.assert_allclose(have[keep], want[keep], rtol=1e-6, atol=1e-6, err_msg=name)


def test_ewm_matches_pandas(spark, both):
    pdf = events(3000, hot=0.95)
    got = win.ewm(frame(spark, pdf), ["key"], "t", "v", ties=["id"]).toPandas().set_index("id")
    for _, g in pdf.sort_values(["t", "id"]).groupby("key"):
        e = g["v"].ewm(alpha=0.1)
        np.testing.assert_allclose(got.loc[g["id"], "ewm_mean"], e.mean(), rtol=1e-9)
        np.testing.assert_allclose(got.loc[g["id"], "ewm_std"].astype(float), e.std(), rtol=1e-7, atol=1e-9)


def test_interpolation_matches_pandas(spark, both):
    pdf = events(400).drop_duplicates(["key", "t"]).reset_index(drop=True)
    pdf.loc[pdf["id"] % 3 != 0, "v"] = None
    got = series.interpolate_time(frame(spark, pdf), ["key"], "t", ["v"], ["id"]).toPandas().set_index("id")
    for _, g in pdf.sort_values("t").groupby("key"):
        want = g.set_index("t")["v"].interpolate(method="time")
        np.testing.assert_allclose(got.loc[g["id"], "v"].astype(float).to_numpy(), want.to_numpy(), rtol=1e-9)


def test_fill_crosses_empty_spans(spark, both):
    pdf = pd.DataFrame({"id": range(5), "key": "a", "t": [T0 + pd.Timedelta(days=d) for d in (0, 3, 9, 10, 40)], "v": [None, 2.0, None, 5.0, None]})
    out = series.fill_forward_back(frame(spark, pdf), ["key"], "t", ["v"], ["id"]).orderBy("id").toPandas()
    assert out["v"].tolist() == [2.0, 2.0, 2.0, 5.0, 5.0]
    back = series.fill_forward_back(frame(spark, pdf), ["key"], "t", ["v"], ["id"], back_first=True).orderBy("id").toPandas()
    assert back["v"].tolist() == [2.0, 2.0, 5.0, 5.0, 5.0]


def test_asof_nearest_matches_brute_force(spark, both):
    rng = random.Random(3)
    left = pd.DataFrame({"id": range(200), "t": [T0 + pd.Timedelta(minutes=rng.randrange(5000)) for _ in range(200)]})
    times = sorted({T0 + pd.Timedelta(minutes=10 * rng.randrange(100, 400)) for _ in range(60)})
    right = pd.DataFrame({"rt": times, "x": [float(i) for i in range(len(times))]})
    out = timejoin.asof_nearest(frame(spark, left), spark.createDataFrame(right).withColumn("rt", F.col("rt").cast("timestamp")), "t", "rt", ["x"])
    got = {r["id"]: r["x"] for r in out.collect()}
    for r in left.itertuples():
        best = min(right.itertuples(), key=lambda q: (abs(q.rt - r.t), q.rt))
        assert got[r.id] == best.x


def test_asof_tie_takes_the_earlier_row(spark):
    left = pd.DataFrame({"t": [T0 + pd.Timedelta(hours=1)]})
    right = pd.DataFrame({"rt": [T0, T0 + pd.Timedelta(hours=2)], "x": [1.0, 2.0]})
    out = timejoin.asof_nearest(frame(spark, left), spark.createDataFrame(right).withColumn("rt", F.col("rt").cast("timestamp")), "t", "rt", ["x"])
    assert out.first()["x"] == 1.0


def test_interval_products_agree(spark):
    rng = random.Random(5)
    left = pd.DataFrame({"id": range(150), "t": [T0 + pd.Timedelta(minutes=rng.randrange(3000)) for _ in range(150)]})
    starts = [T0 + pd.Timedelta(minutes=rng.randrange(2900)) for _ in range(60)]
    iv = pd.DataFrame({"s": starts, "e": [s + pd.Timedelta(minutes=rng.randrange(400)) for s in starts],
                       "f": [rng.choice([0.3, 0.1, -0.4, -1.0, -1.5, 0.0]) for _ in starts]})
    ivs = spark.createDataFrame(iv).withColumns({c: F.col(c).cast("timestamp") for c in ("s", "e")})
    a = timejoin.cover_product(frame(spark, left), ivs, "t", "s", "e", 1 + F.col("f"), "p")
    b = timejoin.running_cover_product(frame(spark, left), ivs, "t", "s", "e", 1 + F.col("f"), "p")
    pa, pb = ({r["id"]: r["p"] for r in x.collect()} for x in (a, b))
    for r in left.itertuples():
        want = math.prod(1 + q.f for q in iv.itertuples() if q.s <= r.t <= q.e)
        assert math.isclose(pa[r.id], want, abs_tol=1e-9)
        assert math.isclose(pb[r.id], want, abs_tol=1e-9)


def haversine(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_matches_brute_force_everywhere(spark, k):
    rng = random.Random(11)
    # a dense cluster, a scatter over the globe, both sides of the date line and the poles
    sites = [(41.39 + rng.random() / 500, 2.17 + rng.random() / 500) for _ in range(120)]
    sites += [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(40)] + [(10.0, 179.99), (10.0, -179.98), (89.9, 30.0), (-89.7, -100.0)]
    pts = [(41.39, 2.17), (41.391, 2.1712), (41.5, 2.3), (10.0, -179.999), (89.95, -150.0), (-89.99, 80.0), (0.0, 0.0)]
    pts += [(rng.uniform(-85, 85), rng.uniform(-180, 180)) for _ in range(20)]
    s = spark.createDataFrame([(i, *p) for i, p in enumerate(sites)], "facility_id long, latitude double, longitude double")
    p = spark.createDataFrame([*pts, pts[0], pts[0]], "latitude double, longitude double")
    got = {}
    for r in spatial.nearest(p, s, k).collect():
        got.setdefault((r["latitude"], r["longitude"]), []).append((r["rank"], r["facility_id"], r["distance_m"]))
    assert len(got) == len(set(pts))
    for pt in pts:
        want = sorted((haversine(*pt, *q), i) for i, q in enumerate(sites))[:k]
        have = sorted(got[pt])
        assert [h[1] for h in have] == [w[1] for w in want], pt
        np.testing.assert_allclose([h[2] for h in have], [w[0] for w in want], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("within", [50.0, 700.0, 3e5, 2.5e7])
def test_nearest_within_matches_brute_force(spark, within):
    rng = random.Random(12)
    sites = [(41.39 + rng.random() / 100, 2.17 + rng.random() / 100) for _ in range(60)] + [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(30)] + [(10.0, 179.99), (89.9, 30.0)]
    pts = [(41.392 + rng.random() / 100, 2.172 + rng.random() / 100) for _ in range(20)] + [(10.0, -179.999), (89.95, -150.0), (0.0, 0.0)] + [(rng.uniform(-85, 85), rng.uniform(-180, 180)) for _ in range(10)]
    s = spark.createDataFrame([(i, *p) for i, p in enumerate(sites)], "facility_id long, latitude double, longitude double")
    got = {(r["latitude"], r["longitude"]): r["facility_id"] for r in spatial.nearest(spark.createDataFrame(pts, "latitude double, longitude double"), s, 1, within_m=within).collect()}
    want = {p: min((haversine(*p, *q), i) for i, q in enumerate(sites)) for p in pts}
    assert got == {p: i for p, (d, i) in want.items() if d < within}


def test_sites_of_one_place_and_far_points_form_few_pairs(spark):
    """10 000 far points, 10 000 sites on one spot."""
    rng = random.Random(13)
    sites = spark.createDataFrame([(i, 41.39, 2.17) for i in range(10_000)], "facility_id long, latitude double, longitude double")
    pts = spark.createDataFrame([(rng.uniform(-60, -20), rng.uniform(-170, -20)) for _ in range(10_000)], "latitude double, longitude double")
    assert spatial.first_of_place(sites.select(F.col("facility_id").alias("__id"), F.col("latitude").alias("__tlat"), F.col("longitude").alias("__tlon")), 3).count() == 3
    out = spatial.nearest(pts, sites, 3)
    assert out.count() == 30_000 and {r["facility_id"] for r in out.select("facility_id").distinct().collect()} == {0, 1, 2}
    assert spatial.nearest(pts, sites, 1, within_m=1000.0).count() == 0


def test_nearest_with_fewer_targets_than_asked(spark):
    s = spark.createDataFrame([(1, 10.0, 10.0), (2, -10.0, 100.0)], "facility_id long, latitude double, longitude double")
    p = spark.createDataFrame([(50.0, 50.0)], "latitude double, longitude double")
    assert spatial.nearest(p, s, 3).count() == 2


def test_kendall_and_spearman_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(12)), float(rng.randrange(9)) + (i % 3) * 0.5) for i in range(220)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    c = d = tx = ty = 0
    for i, a in enumerate(rows):
        for b in rows[:i]:
            s = np.sign(a[1] - b[1]) * np.sign(a[2] - b[2])
            c, d = c + (s > 0), d + (s < 0)
            tx, ty = tx + (a[1] == b[1]), ty + (a[2] == b[2])
    n0 = len(rows) * (len(rows) - 1) / 2
    want = (c - d) / math.sqrt((n0 - tx) * (n0 - ty))
    assert math.isclose(kendall(df, "x", "y").first()["correlation"], want, rel_tol=1e-12)
    pdf = pd.DataFrame(rows, columns=["id", "x", "y"])
    rho = pdf["x"].rank().corr(pdf["y"].rank())
    assert math.isclose(spearman(df, "x", "y").first()["correlation"], rho, rel_tol=1e-12)


def test_correlation_without_variance_is_null(spark):
    from tidemark.operators.correlation import pearson_with_target

    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert pearson_with_target(df, ["x"], "y").first()["correlation"] is None


def test_one_instant_is_cut_into_slices(spark, monkeypatch):
    """All rows at one time: the tie columns cut it, each slice holds a bounded number of rows, and positions stay right."""
    monkeypatch.setattr(slices, "SLICE_ROWS", 50)
    rng = random.Random(8)
    names = [f"n{rng.randrange(60):02d}" for _ in range(600)]
    pdf = pd.DataFrame({"id": rng.sample(range(600), 600), "name": [n if i % 9 else None for i, n in enumerate(names)], "key": ["a"] * 550 + ["b"] * 50, "t": T0})
    df = frame(spark, pdf).withColumn("name", F.col("name"))
    cut_up = slices.with_slice(df, "t", ["name", "id"], slices.needed(df, ["key"]))
    sizes = [r["count"] for r in cut_up.groupBy(slices.SLICE).count().collect()]
    assert len(sizes) > 6 and max(sizes) < 200
    ends = [r for r in cut_up.groupBy(slices.SLICE).agg(F.min(F.struct("name", "id")).alias("lo"), F.max(F.struct("name", "id")).alias("hi")).orderBy(slices.SLICE).collect()]
    order = lambda x: (x["name"] is not None, x["name"] or "", x["id"])
    assert all(order(a["hi"]) < order(b["lo"]) for a, b in zip(ends, ends[1:]))
    got = {r["id"]: r[series.ORDINAL] for r in series.with_ordinal(df, ["key"], "t", ["name", "id"]).collect()}
    for _, g in pdf.groupby("key"):
        want = sorted(g.itertuples(), key=lambda r: (isinstance(r.name, str), r.name if isinstance(r.name, str) else "", r.id))
        assert [got[r.id] for r in want] == list(range(len(want)))


def test_crowded_times_and_null_times_are_ordered(spark, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 30)
    rng = random.Random(9)
    pdf = pd.DataFrame({"id": range(500), "t": [None if i % 5 == 0 else T0 + pd.Timedelta(minutes=rng.choice([3, 3, 3, 7, rng.randrange(60)])) for i in range(500)]})
    df = spark.createDataFrame(pdf.astype({"t": "datetime64[us]"})).withColumn("t", F.col("t").cast("timestamp"))
    got = {r["id"]: r[series.ORDINAL] for r in series.with_ordinal(df, [], "t", ["id"]).collect()}
    want = sorted(pdf.itertuples(), key=lambda r: (not pd.isna(r.t), r.t if not pd.isna(r.t) else T0, r.id))
    assert [got[r.id] for r in want] == list(range(500))


def test_a_large_key_is_not_one_window(spark, monkeypatch):
    df = frame(spark, events(300))
    whole = win.lags(df, ["key"], "t", "v", {"1": 1}, ["id"])._jdf.queryExecution().toString()
    monkeypatch.setattr(slices, "SLICE_ROWS", 40)
    text = win.lags(df, ["key"], "t", "v", {"1": 1}, ["id"])._jdf.queryExecution().toString()
    assert "__block" in text and "__slice" in text and "__block" not in whole and Window is not None


def test_rolling_percentiles_match_brute_force(spark, both):
    pdf = events(350)
    pdf.loc[pdf["id"] % 11 == 0, "v"] = None
    probs = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = win.rolling_percentiles(frame(spark, pdf), ["key"], "t", "v", 24, probs).toPandas().set_index("id")
    assert len(got) == len(pdf)
    for i, g in brute_frames(pdf, 24).items():
        have, want = got.loc[i, [f"percentile_{round(p * 100)}" for p in probs]].to_numpy(float), g["v"].dropna()
        np.testing.assert_allclose(have, np.quantile(want, probs) if len(want) else [np.nan] * 5, rtol=1e-12)


@pytest.mark.parametrize("span_rows, piece_rows, slice_rows", [(10**6, 1, 10**6), (10**6, 60, 10**6), (10**6, 10**6, 10**6), (0, 1, 10**6), (0, 1, 40)])
def test_percentiles_by_piece_and_by_digit_agree_with_brute_force(spark, monkeypatch, span_rows, piece_rows, slice_rows):
    monkeypatch.setattr(slices, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(win, "SPAN_ROWS", span_rows)
    monkeypatch.setattr(win, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(win, "ASKS", 7)
    pdf = pd.concat([events(350)] + [events(350).iloc[:60]])
    pdf["v"] = (pdf["v"] - pdf["v"].mean()).round(1)
    pdf.loc[pdf["id"] % 11 == 0, "v"] = None
    pdf.loc[pdf["id"] % 13 == 0, "key"] = None
    df = frame(spark, pdf).withColumn("t", F.when(F.col("id") % 17 != 0, F.col("t")))
    probs = (0.0, 0.25, 0.5, 0.95, 1.0)
    out = win.rolling_percentiles(df, ["key"], "t", "v", 24, probs)
    text = out._jdf.queryExecution().toString()
    assert ("FlatMapGroupsInArrow" in text) == (span_rows > 0)
    got = out.toPandas()
    assert len(got) == len(pdf)
    names = [f"percentile_{round(p * 100)}" for p in probs]
    assert got.loc[got["id"] % 17 == 0, names].isna().all(axis=None)
    pdf = pdf[pdf["id"] % 17 != 0]
    for r in got[got["id"] % 17 != 0].itertuples():
        same = pdf["key"].isna() if r.key is None or r.key != r.key else pdf["key"] == r.key
        want = pdf[same & (pdf["t"] <= r.t) & (pdf["t"] > r.t - pd.Timedelta(hours=24))]["v"].dropna()
        have = [getattr(r, n) for n in names]
        np.testing.assert_allclose(np.array(have, float), np.quantile(want, probs) if len(want) else [np.nan] * 5, rtol=1e-12, atol=1e-12)


def test_percentiles_of_one_instant_and_one_value(spark, both):
    df = frame(spark, pd.DataFrame({"id": range(120), "key": "a", "t": T0, "v": [float(i % 3) for i in range(120)]}))
    assert {r["percentile_50"] for r in win.rolling_percentiles(df, ["key"], "t", "v").collect()} == {1.0}
    assert {r["percentile_50"] for r in win.rolling_percentiles(df.withColumn("v", F.lit(4.0)), ["key"], "t", "v").collect()} == {4.0}
    none = win.rolling_percentiles(df.withColumn("v", F.lit(None).cast("double")), ["key"], "t", "v").collect()
    assert len(none) == 120 and {r["percentile_50"] for r in none} == {None}


def test_rolling_trend_matches_brute_force(spark, both):
    pdf = events(350)
    got = {r["id"]: r["trend_correlation"] for r in win.rolling_trend(frame(spark, pdf), ["key"], "t", "v", 24, ["id"]).collect()}
    place = {r.id: i for _, g in pdf.groupby("key") for i, r in enumerate(g.sort_values(["t", "id"]).itertuples())}
    for i, g in brute_frames(pdf, 24).items():
        x, y = np.array([place[j] for j in g["id"]], float), g["v"].to_numpy()
        if len(g) < 2 or y.std() < 1e-6:
            assert got[i] is None
        else:
            assert math.isclose(got[i], np.corrcoef(x, y)[0, 1], abs_tol=1e-9)


def test_trend_reads_its_source_twice(spark, tmp_path):
    frame(spark, events(200)).write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    plan = win.rolling_trend(df, ["key"], "t", "v", 24, ["id"])._jdf.queryExecution().executedPlan().toString()
    # one pass counts the keys, one numbers the rows into the checkpoint; the plan that is left reads that
    assert "FileScan" not in plan


def test_rows_without_key_or_time_stay(spark, both):
    t = T0.to_pydatetime()
    rows = [(1, "a", t, 1.0), (2, None, t, 2.0), (3, None, t + timedelta(hours=2), 3.0), (4, "a", None, 4.0)]
    df = spark.createDataFrame(rows, "id int, key string, t timestamp, v double")
    got = {r["id"]: r["p"] for r in series.row_frame(df, ["key"], "t", lambda w: {"p": F.lag("v").over(w)}, ["id"]).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3] == 2.0
    assert series.fill_forward_back(df, ["key"], "t", ["v"], ["id"]).count() == 4
    assert {r["key"]: r["n"] for r in ordered.quantiles(df, "v", [0.5], ["key"]).collect()} == {"a": 2, None: 2}


def test_products_by_place_do_not_pair_moments_and_intervals(spark, both, monkeypatch):
    rng = random.Random(6)
    spots = [1.0, 2.0, None]
    left = [(i, (T0 + pd.Timedelta(minutes=rng.randrange(300))).to_pydatetime(), rng.choice(spots)) for i in range(400)] + [(400, None, 1.0)]
    factors = [0.3, -0.4, -1.5, None, 2.0]
    ivs = []
    for k in range(80):
        s = T0 + pd.Timedelta(minutes=rng.randrange(300))
        ivs.append((s.to_pydatetime(), (s + pd.Timedelta(minutes=rng.randrange(-5, 60))).to_pydatetime(), rng.choice(factors)))
    # late on, a zero, an infinite factor and one that is no number
    late = [T0 + pd.Timedelta(minutes=m) for m in (400, 401, 402, 403, 404)]
    ivs += [(late[0].to_pydatetime(), late[2].to_pydatetime(), 0.0), (late[1].to_pydatetime(), late[4].to_pydatetime(), math.inf), (late[3].to_pydatetime(), late[3].to_pydatetime(), math.nan)]
    left += [(500 + k, t.to_pydatetime(), 1.0) for k, t in enumerate(late)]
    asks = spark.createDataFrame(left, "id int, t timestamp, lat double")
    # a factor that the key changes: it counts at the second place only
    factor = F.when(F.col("lat") > 1.5, F.col("f") * F.col("lat")).otherwise(F.col("f"))
    spans = spark.createDataFrame(ivs, "s timestamp, e timestamp, f double")
    monkeypatch.setattr(timejoin, "_paired", lambda *a: pytest.fail("pairs of moments and intervals"))
    got = {r["id"]: r["p"] for r in timejoin.cover_product(asks, spans, "t", "s", "e", factor, "p", ["lat"]).collect()}
    assert len(got) == len(left)
    for i, t, lat in left:
        hit = [] if t is None or lat is None else [f * (2.0 if lat > 1.5 else 1.0) for s, e, f in ivs if f is not None and s <= t <= e]
        want = math.prod(hit)
        assert math.isnan(got[i]) if math.isnan(want) else got[i] == pytest.approx(want, rel=1e-9), (i, got[i], want)
    assert got[400] == 1.0 and got[500] == 0.0 and math.isnan(got[501]) and got[504] == math.inf


def test_products_of_many_places_pair_moments_and_intervals(spark):
    left = spark.range(30).select("id", F.lit(T0).cast("timestamp").alias("t"), F.col("id").cast("double").alias("lat"))
    spans = spark.createDataFrame([(T0.to_pydatetime(), T0.to_pydatetime(), 2.0)], "s timestamp, e timestamp, f double")
    assert {r["p"] for r in timejoin.cover_product(left, spans, "t", "s", "e", F.col("f"), "p", ["lat"]).collect()} == {2.0}
