"""Record validation and data-quality statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import rules
from tidemark.functions.stats import kolmogorov_sf, normal_cdf
from tidemark.operators.aggs import long_form
from tidemark.operators.correlation import correlation_pairs
from tidemark.plans.ordered import frequencies, quantiles, running
from tidemark.plans.scalars import with_row, with_stats


def validate(df: DataFrame, kind: str) -> DataFrame:
    """Add `reasons`; when required columns are missing every row carries those reasons only."""
    absent = [c for c in rules.REQUIRED[kind] if c not in df.columns]
    if absent:
        return df.withColumn("reasons", F.array(*[F.lit(f"missing_column_{c}") for c in absent]))
    return df.withColumn("reasons", rules.reasons(rules.RULES[kind]()))


def validation_summary(validated: DataFrame) -> DataFrame:
    """(item, amount): totals, percentage and the count of every reason."""
    bad = F.count_if(F.size("reasons") > 0)
    one = validated.agg(F.count(F.lit(1)).alias("total_count"), bad.alias("invalid_count"))
    one = one.select(
        F.col("total_count").cast("double").alias("total_count"), F.col("invalid_count").cast("double").alias("invalid_count"),
        (F.col("total_count") - F.col("invalid_count")).cast("double").alias("valid_count"),
        F.coalesce(F.try_divide((F.col("total_count") - F.col("invalid_count")) * 100.0, F.col("total_count")), F.lit(0.0)).alias("valid_percentage"))
    per = validated.select(F.explode("reasons").alias("item")).groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("amount"))
    return one.unpivot([], one.columns, "item", "amount").unionByName(per)


def invalid_sample(validated: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First n invalid rows in key order."""
    return validated.where(F.size("reasons") > 0).orderBy(key).limit(n)


def outlier_counts(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows outside k interquartile ranges per column, with the bounds and the share of all rows."""
    u = long_form(df, cols)
    q = quantiles(u, "v", [0.25, 0.75], ["column_name"]).select("column_name", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    b = q.select("column_name", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
                 (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    j = u.join(b, "column_name")
    out = F.count_if((F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound")))
    return j.groupBy("column_name", "lower_bound", "upper_bound").agg(
        out.alias("outliers"), F.try_divide(out * 100.0, F.count(F.lit(1))).alias("outlier_pct"))


def reference_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population mean / std and default range (mean +- 3 std) per column."""
    p = long_form(df, cols).groupBy("column_name").agg(F.avg("v").alias("ref_mean"), F.stddev_pop("v").alias("ref_std"))
    return p.select("*", (F.col("ref_mean") - 3 * F.col("ref_std")).alias("low"), (F.col("ref_mean") + 3 * F.col("ref_std")).alias("high"))


def quality_rates(df: DataFrame, profile: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing and out-of-range share per feature."""
    j = long_form(df, cols).join(profile, "column_name")
    n = F.count(F.lit(1))
    return j.groupBy("column_name").agg(
        n.alias("rows"), (F.count_if(F.col("v").isNull()) / n).alias("missing_rate"),
        (F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))) / n).alias("out_of_range_rate"))


def correlation_changes(reference: DataFrame, current: DataFrame, cols: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """Pairs whose correlation moved by more than the threshold."""
    r = correlation_pairs(reference, cols).withColumnRenamed("correlation", "ref_corr")
    c = correlation_pairs(current, cols).withColumnRenamed("correlation", "cur_corr")
    j = r.join(c, ["feature_a", "feature_b"])
    return j.withColumn("change", F.col("cur_corr") - F.col("ref_corr")).where(F.abs("change") > threshold)


def distribution_shift(current: DataFrame, profile: DataFrame, cols: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """Mean shift in reference deviations, deviation ratio, and the distance of the sample to N(mean, std)."""
    u = long_form(current, cols)
    stats = u.groupBy("column_name").agg(F.avg("v").alias("cur_mean"), F.stddev_pop("v").alias("cur_std"))
    r = running(frequencies(u, "v", ["column_name"]), "v", ["column_name"]).join(profile, "column_name")
    cdf = normal_cdf(F.try_divide(F.col("v") - F.col("ref_mean"), F.col("ref_std")))
    n = F.col("n_total").cast("double")
    gap = F.greatest((F.col("n_below") + F.col("n")) / n - cdf, cdf - F.col("n_below") / n)
    d = r.groupBy("column_name").agg(F.max(gap).alias("ks_statistic"), F.max("n_total").alias("sample_size"))
    out = stats.join(profile, "column_name").join(d, "column_name")
    p = kolmogorov_sf(F.sqrt(F.col("sample_size").cast("double")) * F.col("ks_statistic"))
    return out.select(
        "column_name", F.try_divide(F.col("cur_mean") - F.col("ref_mean"), F.col("ref_std")).alias("mean_shift"),
        F.try_divide(F.col("cur_std"), F.col("ref_std")).alias("std_ratio"), "ks_statistic", p.alias("p_value"),
        (p < threshold).alias("is_significant"), "sample_size")


def quality_score(rates: DataFrame, changes: DataFrame, shifts: DataFrame) -> DataFrame:
    """One row: product of the penalties for missing, out-of-range, correlation and distribution issues."""
    base = rates.agg(F.avg("missing_rate").alias("missing_rate"), F.avg("out_of_range_rate").alias("out_of_range_rate"))
    base = with_row(base, changes.agg(F.avg(F.abs("change")).alias("m")), "__c")
    base = with_row(base, shifts.agg(F.avg(F.when(F.col("is_significant"), F.col("ks_statistic"))).alias("m")), "__s")
    score = (1 - F.col("missing_rate")) * (1 - F.col("out_of_range_rate"))
    score = score * F.greatest(F.lit(0.0), 1 - F.coalesce(F.col("__c.m"), F.lit(0.0)))
    score = score * F.greatest(F.lit(0.0), 1 - F.coalesce(F.col("__s.m"), F.lit(0.0)))
    return base.select("missing_rate", "out_of_range_rate", score.alias("quality_score"))


def issue_importance(rates: DataFrame, changes: DataFrame, shifts: DataFrame) -> DataFrame:
    """Contribution of each feature to the issues, divided by the largest."""
    parts = rates.select("column_name", F.lit(0.0).alias("x")).unionByName(
        shifts.where("is_significant").select("column_name", F.col("ks_statistic").alias("x")))
    for side in ("feature_a", "feature_b"):
        parts = parts.unionByName(changes.select(F.col(side).alias("column_name"), (F.abs("change") / 2).alias("x")))
    total = parts.groupBy("column_name").agg(F.sum("x").alias("x"))
    s = with_stats(total, top=F.max("x"))
    return s.select("column_name", F.coalesce(F.try_divide(F.col("x"), F.col("__stats.top")), F.lit(0.0)).alias("importance"))


def validate_metrics(df: DataFrame, as_of: str, value: str = "value", time: str = "timestamp") -> DataFrame:
    """Reasons of a metric record: identifiers given, value finite, time not after `as_of`."""
    v = F.col(value)
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.withColumn("reasons", rules.reasons({
        "missing_model_id": F.col("model_id").isNull(), "missing_metric_name": F.col("metric_name").isNull(),
        "value_not_finite": rules.not_true(finite), "timestamp_missing": F.col(time).isNull(),
        "timestamp_in_future": F.coalesce(F.col(time) > F.lit(as_of).cast("timestamp"), F.lit(False))}))


# Limits of the metric check and their direction.
METRIC_LIMITS = {"rmse": (0.5, "above"), "mae": (0.4, "above"), "r2": (0.7, "below")}


def metric_violations(df: DataFrame, metric: str = "metric_name", value: str = "value", limits: dict = METRIC_LIMITS) -> DataFrame:
    """Rows beyond their metric's limit, with the limit and the direction."""
    limit, direction = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, (x, way) in limits.items():
        limit = F.when(F.col(metric) == name, x).otherwise(limit)
        direction = F.when(F.col(metric) == name, way).otherwise(direction)
    d = df.withColumn("threshold", limit).withColumn("direction", direction)
    return d.where(F.when(F.col("direction") == "above", F.col(value) > F.col("threshold")).otherwise(F.col(value) < F.col("threshold")))


def outlier_labels(df: DataFrame, rate: str, temperature: str, rain: str, top: float = 100.0) -> DataFrame:
    """is_outlier (empty or above the top) and extreme_weather (above the 95th percentile of either)."""
    q = quantiles(long_form(df, [temperature, rain]), "v", [0.95], ["column_name"])
    p95 = q.agg(*[F.max(F.when(F.col("column_name") == c, F.col("q")[0])).alias(n) for c, n in ((temperature, "t"), (rain, "p"))])
    s = with_row(df, p95, "__p95")
    return s.withColumn("is_outlier", (F.col(rate) == 0) | (F.col(rate) > top)).withColumn(
        "extreme_weather", (F.col(temperature) > F.col("__p95.t")) | (F.col(rain) > F.col("__p95.p"))).drop("__p95")
