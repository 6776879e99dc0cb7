"""Drift of batches against a reference: profiles, distances, two-sample tests, seasonal adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.stats import chi2_p, ks_p_value
from tidemark.operators.aggs import long_form
from tidemark.plans.ordered import quantiles, running
from tidemark.plans.scalars import with_row
from tidemark.plans.series import row_frame, with_ordinal
from tidemark.session import cut


def baseline_profile(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Profile table: (feature, kind, category, mean, std, q25, q50, q75, share)."""
    u = long_form(df, numeric).where(F.col("v").isNotNull())
    m = u.groupBy("column_name").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    q = quantiles(u, "v", [0.25, 0.5, 0.75], ["column_name"])
    num = m.join(q, "column_name").select(
        F.col("column_name").alias("feature"), F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("category"), "mean", "std",
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), F.lit(None).cast("double").alias("share"))
    if not categorical:
        return num
    return num.unionByName(category_shares(df, categorical).select("feature", F.lit("categorical").alias("kind"), "category", "share"),
                           allowMissingColumns=True)


def category_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, category, share) over the non-null values."""
    u = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "feature", "category").where(F.col("category").isNotNull())
    n = u.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("feature").agg(F.sum("n").alias("total"))
    return n.join(total, "feature").select("feature", "category", (F.col("n") / F.col("total")).alias("share"))


def _relative(now: Column, base: Column) -> Column:
    return F.abs(now - base) / F.when(base != 0, F.abs(base)).otherwise(1.0)


def numeric_drift(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Relative mean and std change, and the distance of the sample to the single point of the baseline
    mean: D = max(F(m), 1 - F(m)), p = min(1, 2 (n - ceil(n D) + 1) / (n + 1))."""
    base = profile.where(F.col("kind") == "numeric").select("feature", F.col("mean").alias("__m"), F.col("std").alias("__s"))
    have = [r["feature"] for r in base.select("feature").collect() if r["feature"] in df.columns]  # one row per column
    u = long_form(df, have, name="feature").where(F.col("v").isNotNull()).join(base, "feature")
    s = u.groupBy("feature", "__m", "__s").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.count_if(F.col("v") <= F.col("__m")).alias("upto"), F.count_if(F.col("v") < F.col("__m")).alias("below"))
    n = F.col("n").cast("double")
    # the point itself counts half of a step: below it the sample leads, from it on the point leads
    d = F.greatest(F.col("below") / n, 1 - F.col("upto") / n)
    p = F.least(F.lit(1.0), 2.0 * (n - F.ceil(F.round(n * d, 6)) + 1) / (n + 1))
    return s.select("feature", d.alias("ks_statistic"), p.alias("p_value"), _relative(F.col("mean"), F.col("__m")).alias("mean_difference"),
                    F.coalesce(_relative(F.col("std"), F.col("__s")), F.lit(0.0)).alias("std_difference"))


def category_drift(current: DataFrame, shares: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Half the summed share differences (at most 1) with the new and missing categories."""
    now = category_shares(current, cols).withColumnRenamed("share", "cur")
    j = shares.select("feature", "category", F.col("share").alias("ref")).join(now, ["feature", "category"], "full")
    ref, cur = F.coalesce("ref", F.lit(0.0)), F.coalesce("cur", F.lit(0.0))
    return j.groupBy("feature").agg(
        F.least(F.lit(1.0), F.sum(F.abs(ref - cur)) / 2).alias("distribution_difference"),
        F.sort_array(F.collect_list(F.when(F.col("ref").isNull(), F.col("category")))).alias("new_categories"),
        F.sort_array(F.collect_list(F.when(F.col("cur").isNull(), F.col("category")))).alias("missing_categories"))


# Limits of the drift decision.
DRIFT_LIMITS = {"ks_statistic": 0.1, "mean_difference": 0.2, "std_difference": 0.2, "distribution_difference": 0.3}


def drift_decision(metrics: DataFrame, limits: dict[str, float] = DRIFT_LIMITS) -> DataFrame:
    """Per feature and overall flag of a table with any of the limit columns."""
    hit = F.lit(False)
    for c, limit in limits.items():
        if c in metrics.columns:
            hit = hit | F.coalesce(F.col(c) > limit, F.lit(False))
    d = metrics.withColumn("drift_detected", hit)
    return with_row(d, d.agg(F.bool_or("drift_detected").alias("any")), "__any").withColumn("batch_drift", F.col("__any.any")).drop("__any")


def two_sample(reference: DataFrame, current: DataFrame, cols: Sequence[str], min_samples: int = 1000, alpha: float = 0.05,
               keys: Sequence[str] = ()) -> DataFrame:
    """Two-sample distance and p-value per feature from running counts over distinct values.

    A feature with fewer than `min_samples` values on a side keeps its row without p-value and decision; one that a side lacks
    altogether has no distance either."""
    def side(df, ref):
        return long_form(df, cols, keys, name="feature").where(F.col("v").isNotNull()).groupBy(*keys, "feature", "v").agg(
            F.sum(F.lit(1 if ref else 0)).alias("a"), F.sum(F.lit(0 if ref else 1)).alias("b"))

    by = [*keys, "feature"]
    f = side(reference, True).unionByName(side(current, False)).groupBy(*by, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    r = running(f, "v", by, ["a", "b"])
    gap = F.abs(F.try_divide(F.col("a_below") + F.col("a"), F.col("a_total")) - F.try_divide(F.col("b_below") + F.col("b"), F.col("b_total")))
    s = r.groupBy(*by).agg(
        F.max(gap).alias("drift_score"), F.max("a_total").alias("n_reference"), F.max("b_total").alias("n_current"))
    enough = (F.least("n_reference", "n_current") >= min_samples) & F.col("drift_score").isNotNull()
    p = F.when(enough, ks_p_value(F.col("drift_score"), F.greatest("n_reference", F.lit(1)), F.greatest("n_current", F.lit(1))))
    return s.withColumn("p_value", p).withColumn(
        "is_drift_detected", F.col("p_value") < alpha).withColumn("sample_size", F.least("n_reference", "n_current"))


def distribution_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean, population std, quartiles, min and max per column."""
    u = long_form(df, cols, name="feature").where(F.col("v").isNotNull())
    m = u.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(u, "v", [0.25, 0.5, 0.75], ["feature"])
    return m.join(q, "feature").select("feature", "mean", "std", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"),
                                       F.col("q")[2].alias("q3"), "min", "max")


def seasonal_adjust(df: DataFrame, time: str, value: str, period: int, ties: Sequence[str] = ()) -> DataFrame:
    """Remove the additive seasonal part: centred moving average as trend (2 x period for an even
    period, ends extrapolated linearly from `period` trend points), period means of the rest, centred."""
    half = period // 2
    o = with_ordinal(df, [], time, ties, name="__i")

    def compute(w):
        if period % 2:
            f = w.rowsBetween(-half, half)
            full = F.count(value).over(f) == period
            t = F.sum(value).over(f) / period
        else:
            f = w.rowsBetween(-half, half)
            full = F.count(value).over(f) == period + 1
            ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
            t = (F.sum(value).over(f) - ends / 2) / period
        return {"__trend": F.when(full, t)}

    # read by the trend ends, the period means and the result
    t = cut(row_frame(o, [], time, compute, ties, before=half, after=half))
    known = t.where(F.col("__trend").isNotNull()).select("__i", "__trend")
    span = known.agg(F.min("__i").alias("first"), F.max("__i").alias("last"))
    fit = [F.regr_slope("__trend", F.col("__i").cast("double")).alias("slope"), F.regr_intercept("__trend", F.col("__i").cast("double")).alias("base")]
    sp = with_row(known, span, "__s")
    # the continuation is fitted to the first `period` trend points, and to the `period` before the last one
    inner = F.col("__i") < F.col("__s.last")
    head = sp.where(inner & (F.col("__i") < F.col("__s.first") + period)).agg(*fit)
    tail = sp.where(inner & (F.col("__i") >= F.col("__s.last") - period)).agg(*fit)
    t = with_row(with_row(with_row(t, span, "__s"), head, "__h"), tail, "__t")
    i = F.col("__i").cast("double")
    trend = (F.when(F.col("__i") < F.col("__s.first"), F.col("__h.base") + F.col("__h.slope") * i)
             .when(F.col("__i") > F.col("__s.last"), F.col("__t.base") + F.col("__t.slope") * i).otherwise(F.col("__trend")))
    t = t.withColumn("__trend", trend).drop("__s", "__h", "__t").withColumn("__p", F.col("__i") % period)
    means = t.groupBy("__p").agg(F.avg(F.col(value) - F.col("__trend")).alias("__season"))
    centred = with_row(means, means.agg(F.avg("__season").alias("m")), "__c").select("__p", (F.col("__season") - F.col("__c.m")).alias("__season"))
    return t.join(centred, "__p").withColumn("adjusted", F.col(value) - F.col("__season")).drop("__i", "__trend", "__p", "__season")


def seasonal_two_sample(reference: DataFrame, current: DataFrame, time: str, value: str, period: int, ties: Sequence[str] = (),
                        min_samples: int = 1000) -> DataFrame:
    a = seasonal_adjust(reference, time, value, period, ties).select(F.col("adjusted").alias(value))
    b = seasonal_adjust(current, time, value, period, ties).select(F.col("adjusted").alias(value))
    return two_sample(a, b, [value], min_samples).withColumn("seasonal_adjusted", F.lit(True))


def concept_drift(reference: DataFrame, current: DataFrame, actual: str = "actual", predicted: str = "predicted",
                  min_samples: int = 1000) -> DataFrame:
    """Two-sample test on the absolute errors."""
    err = F.abs(F.col(predicted) - F.col(actual)).alias("prediction_error")
    return two_sample(reference.select(err), current.select(err), ["prediction_error"], min_samples)


def chi_square(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Contingency statistic of sample x category per column."""
    def side(df, name):
        u = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "feature", "category")
        return u.where(F.col("category").isNotNull()).groupBy("feature", "category").agg(F.count(F.lit(1)).alias(name))

    j = side(reference, "a").join(side(current, "b"), ["feature", "category"], "full").fillna(0, ["a", "b"])
    t = j.groupBy("feature").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("k"))
    j = j.join(t, "feature")
    row = (F.col("a") + F.col("b")).cast("double")
    total = F.col("ta") + F.col("tb")
    ea, eb = row * F.col("ta") / total, row * F.col("tb") / total
    term = (F.col("a") - ea) * (F.col("a") - ea) / ea + (F.col("b") - eb) * (F.col("b") - eb) / eb
    return j.groupBy("feature").agg(F.sum(term).alias("statistic"), (F.max("k") - 1).alias("dof"))


def tabular_drift(reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """All shared features: distance test for numbers, contingency test for categories. A feature drifts
    below alpha; the table drifts when any is below alpha / number of features."""
    out = two_sample(reference, current, numeric, 1).select("feature", F.col("drift_score").alias("statistic"), "p_value")
    if categorical:
        c = chi_square(reference, current, categorical)
        out = out.unionByName(c.select("feature", "statistic", chi2_p("statistic", F.col("dof").cast("double")).alias("p_value")))
    m = len(numeric) + len(categorical)
    out = out.withColumn("drift_detected", F.col("p_value") < alpha).withColumn("threshold", F.lit(alpha))
    return with_row(out, out.agg(F.bool_or(F.col("p_value") < alpha / m).alias("any")), "__a").withColumn("table_drift", F.col("__a.any")).drop("__a")


def drift_summary(results: DataFrame) -> DataFrame:
    """One row: table flag, number of drifting features and their names (one name per column)."""
    return results.agg(F.bool_or("table_drift").alias("drift_detected"), F.count_if("drift_detected").alias("n_features_with_drift"),
                       F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("drift_detected"), F.col("feature"))))).alias("features_with_drift"))
