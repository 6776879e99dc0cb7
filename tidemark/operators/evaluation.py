"""Model evaluation from prediction tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.windows import complete_windows
from tidemark.plans.ordered import quantiles, with_group_stats
from tidemark.plans.series import row_frame

Metric = Callable[[Column, Column, Column], Column]


def _rmse(y: Column, p: Column, w: Column) -> Column:
    return F.sqrt(F.try_divide(F.sum(w * (y - p) * (y - p)), F.sum(w)))


def _mae(y: Column, p: Column, w: Column) -> Column:
    return F.try_divide(F.sum(w * F.abs(y - p)), F.sum(w))


def _r2(y: Column, p: Column, w: Column) -> Column:
    square = F.sum(w * y * y)
    total = square - F.try_divide(F.sum(w * y) * F.sum(w * y), F.sum(w))
    # without variance there is nothing to explain: null
    return F.when(total > square * 1e-14, 1 - F.sum(w * (y - p) * (y - p)) / total)


def _mape(y: Column, p: Column, w: Column) -> Column:
    return F.avg(F.when(y != 0, F.abs((y - p) / y))) * 100


# Metric name -> builder of an aggregate Column from (actual, predicted, weight).
METRICS: dict[str, Metric] = {"rmse": _rmse, "mae": _mae, "r2": _r2, "mape": _mape}


def register_metric(name: str, builder: Metric) -> None:
    """Make a metric available to `regression_metrics`; builders return one aggregate Column."""
    METRICS[name] = builder


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted",
                       weight: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Registered metrics per key in one aggregation. Rows without a pair of values do not count."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    have = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    wanted = list(METRICS) if names is None else list(names)
    unknown = [n for n in wanted if n not in METRICS]
    if unknown:
        raise ValueError(f"no metric registered as {unknown}")
    return have.groupBy(*keys).agg(*[METRICS[n](y, p, w).alias(n) for n in wanted], F.count(F.lit(1)).alias("sample_size"))


def classification_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 from confusion counts."""
    cells = df.groupBy(*keys, F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(*keys, F.col("a").alias("c"), F.col("n").alias("support"), F.lit(0).alias("called"), hit.alias("tp")).unionByName(
        cells.select(*keys, F.col("p").alias("c"), F.lit(0).alias("support"), F.col("n").alias("called"), F.lit(0).alias("tp")))
    per = sides.groupBy(*keys, "c").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))
    zero = F.lit(0.0)
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("called")), zero)
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), zero)
    n = F.sum("support")
    return per.groupBy(*keys).agg(
        (F.sum("tp") / n).alias("accuracy"), (F.sum(F.col("support") * prec) / n).alias("precision"),
        (F.sum(F.col("support") * rec) / n).alias("recall"), (F.sum(F.col("support") * f1) / n).alias("f1"))


# Poisson(1) distribution function at 0, 1, 2, ... up to double precision.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype="float64")) for k in range(18)])


def _mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer: well-spread 64-bit values from 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# The same for numbers below 2^53: u / 2^53 exceeds a value of the function if u exceeds this one.
_POISSON_53 = np.floor(_POISSON * float(1 << 53)).astype("uint64")


def _draws(u: np.ndarray) -> np.ndarray:
    """Poisson(1) draws from uniform numbers below 2^53: comparisons for the usual ones, a search for those above."""
    out = np.zeros(u.shape, np.uint8)
    for t in _POISSON_53[:5]:
        out += u > t
    rare = out == 5
    out[rare] = np.searchsorted(_POISSON, u[rare].astype("float64") / float(1 << 53))
    return out


def bootstrap_interval(df: DataFrame, ids: Sequence[str], actual: str = "actual", predicted: str = "predicted", replicates: int = 1000,
                       level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile intervals of RMSE and MAE by the Poisson bootstrap.

    The weight of a row in a replicate is a Poisson(1) draw from a hash of (row, replicate), so a
    retried task draws the same weights. Tasks add weighted sums over their rows; only one row per
    replicate and task is shuffled."""
    e = F.col(actual) - F.col(predicted)
    rows = df.select(F.xxhash64(*ids, F.lit(seed)).alias("h"), (e * e).alias("sq"), F.abs(e).alias("ab")).dropna()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = _mix(np.arange(1, replicates + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15))
        total = np.zeros((replicates, 3))
        for pdf in batches:
            h = pdf["h"].to_numpy().astype("int64").view("uint64")
            body = np.stack([np.ones(len(pdf)), pdf["sq"].to_numpy(), pdf["ab"].to_numpy()], axis=1)
            for lo in range(0, len(h), 12):  # blocks that stay in the processor's cache
                total += _draws(_mix(h[lo:lo + 12][None, :] ^ salt[:, None]) >> np.uint64(11)).astype("float64") @ body[lo:lo + 12]
        yield pd.DataFrame({"b": np.arange(replicates), "n": total[:, 0], "sq": total[:, 1], "ab": total[:, 2]})

    per = rows.mapInPandas(sums, "b long, n double, sq double, ab double").groupBy("b").agg(
        F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("ab").alias("ab"))
    r = per.select(F.sqrt(F.try_divide(F.col("sq"), F.col("n"))).alias("rmse"), F.try_divide(F.col("ab"), F.col("n")).alias("mae"))
    long = r.unpivot([], ["rmse", "mae"], "metric", "v")
    q = quantiles(long, "v", [(1 - level) / 2, (1 + level) / 2], ["metric"])
    return q.select("metric", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def normality(df: DataFrame, residual: Column, keys: Sequence[str] = ()) -> DataFrame:
    """D'Agostino-Pearson K² of the residuals and its p-value, from moments."""
    g = df.groupBy(*keys).agg(F.count(residual).cast("double").alias("n"), F.skewness(residual).alias("g1"), F.kurtosis(residual).alias("g2"))
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("g2") + 3
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    a = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(a + F.sqrt(a * a + 1)) / F.sqrt(0.5 * F.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    big = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    den = 1 + x * F.sqrt(2 / (big - 4))
    part = F.signum(den) * F.pow((1 - 2 / big) / F.abs(den), F.lit(1.0 / 3))
    z2 = (1 - 2 / (9 * big) - part) / F.sqrt(2 / (9 * big))
    k2 = z1 * z1 + z2 * z2
    return g.select(*keys, k2.alias("k2"), F.exp(-k2 / 2).alias("p_value"), n.cast("bigint").alias("sample_size"))


def heteroscedasticity(df: DataFrame, actual: str = "actual", predicted: str = "predicted", keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    sq = e * e
    return df.groupBy(*keys).agg(F.abs(F.try_divide(F.covar_pop(sq, F.col(actual)), F.stddev_pop(sq) * F.stddev_pop(actual))).alias("heteroscedasticity"))


def durbin_watson(df: DataFrame, time: str, ties: Sequence[str], actual: str = "actual", predicted: str = "predicted",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Sum of squared residual steps over the sum of squared residuals, in the order (time, ties)."""
    r = df.withColumn("__e", F.col(predicted) - F.col(actual))
    r = row_frame(r, keys, time, lambda w: {"__step": F.col("__e") - F.lag("__e").over(w)}, ties, before=1)
    return r.groupBy(*keys).agg(F.try_divide(F.sum(F.col("__step") * F.col("__step")), F.sum(F.col("__e") * F.col("__e"))).alias("durbin_watson"))


OPERATORS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def threshold_violations(df: DataFrame, value: str, threshold: str, op: str = ">") -> DataFrame:
    """is_violated, margin and severity (LOW below 10 %, MEDIUM 25 %, HIGH 50 %, else CRITICAL)."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}; one of {list(OPERATORS)}")
    hit = OPERATORS[op](F.col(value), F.col(threshold))
    margin = F.when(hit, F.abs(F.col(value) - F.col(threshold))).otherwise(0.0)
    rel = F.when(F.col(threshold) != 0, margin / F.col(threshold)).otherwise(float("inf"))
    severity = F.when(rel < 0.1, "LOW").when(rel < 0.25, "MEDIUM").when(rel < 0.5, "HIGH").otherwise("CRITICAL")
    return df.withColumn("is_violated", hit).withColumn("violation_margin", margin).withColumn("severity", severity)


def window_metrics(df: DataFrame, time: str = "timestamp", model: str = "model_id", location: str = "location_id", days: int = 7) -> DataFrame:
    """Metrics per model and complete window of dates: every global model and every location."""
    w = complete_windows(df, time, days)
    sides = F.array(F.col(model), F.concat(F.lit("location_"), F.col(location)))
    rows = w.select("*", F.explode(sides).alias("model"))
    return regression_metrics(rows, ["window_idx", "window_start", "window_end", "model"], names=["rmse", "r2", "mae"])


def _direction(metric: str, value: Column) -> Column:
    """Smaller is better after this: R² changes sign."""
    return F.when(F.col(metric) == "r2", -value).otherwise(value)


def compare_models(df: DataFrame, as_of: str, days: int = 7, time: str = "timestamp", model: str = "model_id", metric: str = "metric_name",
                   value: str = "value") -> DataFrame:
    """Mean of each metric per model in the window, the best model and its improvement over the second."""
    m = df.where((F.col(time) > F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")) & (F.col(time) <= F.lit(as_of).cast("timestamp")))
    m = m.groupBy(metric, model).agg(F.avg(value).alias("mean_value"))
    # one row per model
    order = Window.partitionBy(metric).orderBy(_direction(metric, F.col("mean_value")), model)
    ranked = m.withColumn("rank", F.row_number().over(order))
    picks = ranked.groupBy(metric).agg(
        F.max(F.when(F.col("rank") == 1, F.col(model))).alias("best_model"), F.max(F.when(F.col("rank") == 1, F.col("mean_value"))).alias("best_value"),
        F.max(F.when(F.col("rank") == 2, F.col("mean_value"))).alias("__second"), F.count(F.lit(1)).alias("models"))
    gain = F.coalesce(F.abs(F.try_divide(F.col("best_value") - F.col("__second"), F.col("__second"))) * 100, F.lit(0.0))
    return picks.select(metric, "best_model", "best_value", gain.alias("improvement"), "models")


def rank_models(df: DataFrame, weights: dict[str, float], model: str = "model_id", metric: str = "metric_name", value: str = "value") -> DataFrame:
    """Weighted score of min-max normalised metric means, best model 1.0."""
    m = df.where(F.col(metric).isin(list(weights))).groupBy(metric, model).agg(F.avg(value).alias("v"))
    m = with_group_stats(m, [metric], lo=F.min("v"), hi=F.max("v"))
    norm = (F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    norm = F.when(F.col(metric) == "r2", norm).otherwise(1 - norm)
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col(metric) == name, F.lit(float(w))).otherwise(weight)
    s = m.groupBy(model).agg(F.sum(norm * weight).alias("score"))
    top = s.agg(F.max("score").alias("m")).scalar()
    return s.withColumn("__top", top).select(model, F.try_divide(F.col("score"), F.col("__top")).alias("score")).orderBy(F.col("score").desc(), model)


def feature_set_impact(results: DataFrame) -> DataFrame:
    """Relative R² and RMSE change: advanced against basic features, location models against the global one."""
    one = results.groupBy().pivot("key", ["global_basic", "global_advanced", "location_advanced"]).agg(F.first("r2").alias("r2"), F.first("rmse").alias("rmse"))
    gb, ga, la = ("global_basic", "global_advanced", "location_advanced")

    def change(new, old):
        return (F.try_divide(F.col(f"{new}_r2") - F.col(f"{old}_r2"), F.col(f"{old}_r2")) * 100,
                F.try_divide(F.col(f"{old}_rmse") - F.col(f"{new}_rmse"), F.col(f"{old}_rmse")) * 100)

    r1, e1 = change(ga, gb)
    r2, e2 = change(la, ga)
    return one.select(r1.alias("feature_r2_gain_pct"), e1.alias("feature_rmse_gain_pct"), r2.alias("location_r2_gain_pct"), e2.alias("location_rmse_gain_pct"))


def fold_summary(predictions: DataFrame, fold: str = "fold", actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(kind, rmse, r2, mae): plain mean of the folds, mean weighted by fold size, pooled over all rows."""
    names = ["rmse", "r2", "mae"]
    folds = regression_metrics(predictions, [fold], actual, predicted, names=names)
    plain = folds.agg(*[F.avg(n).alias(n) for n in names]).withColumn("kind", F.lit("mean"))
    sized = folds.agg(*[F.try_divide(F.sum(F.col(n) * F.col("sample_size")), F.sum("sample_size")).alias(n) for n in names]).withColumn("kind", F.lit("weighted"))
    pooled = regression_metrics(predictions, [], actual, predicted, names=names).drop("sample_size").withColumn("kind", F.lit("pooled"))
    return plain.unionByName(sized).unionByName(pooled)
