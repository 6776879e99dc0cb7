"""Repair of records, outliers and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import rules
from tidemark.plans.ordered import quantiles
from tidemark.plans.scalars import with_row, with_stats
from tidemark.plans.series import interpolate_time


def confidence(p: Column) -> Column:
    """0.7 at the extremes, 0.95 at one half."""
    return F.lit(0.7) + F.lit(0.25) * (1 - 2 * F.abs(p - 0.5))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip that keeps nulls."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def mode_of(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """One row `m`: the most frequent value, the lowest on a tie."""
    have = df.where(F.col(col).isNotNull() if where is None else where)
    n = have.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m"))


def median_of(df: DataFrame, col: str) -> DataFrame:
    """One row `m`: the exact median."""
    return quantiles(df, col, [0.5]).select(F.col("q")[0].alias("m"))


def medians_of(df: DataFrame, **columns: Column) -> DataFrame:
    """One row with the exact median of every column; times are given and returned in microseconds."""
    wide = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    q = quantiles(wide.unpivot([], list(columns), "__name", "__v"), "__v", [0.5], ["__name"])
    return q.agg(*[F.max(F.when(F.col("__name") == n, F.col("q")[0])).alias(n) for n in columns])


def _instant(us: Column) -> Column:
    return F.timestamp_micros(F.floor(us))


def fix_features(df: DataFrame) -> DataFrame:
    """Repair feature records: share clipped and filled, flag 0/1, weekday and hour from the time else
    the mode, weekend added, time filled with the median."""
    at = rules.parse_time(F.col("timestamp"))
    d = df.withColumn("occupancy_rate", clip(F.col("occupancy_rate"), 0.0, 1.0)).withColumn("__at", at)
    d = with_row(d, medians_of(d, rate=F.col("occupancy_rate"), time=F.unix_micros("__at")), "__med")
    d = with_row(d, mode_of(df, "day_of_week", F.col("day_of_week").between(0, 6)), "__dow")
    d = with_row(d, mode_of(df, "hour_of_day", F.col("hour_of_day").between(0, 23)), "__hod")
    weekday = F.when(F.col("day_of_week").between(0, 6), F.col("day_of_week")).otherwise(F.coalesce(F.weekday("__at"), F.col("__dow.m")))
    hour = F.when(F.col("hour_of_day").between(0, 23), F.col("hour_of_day")).otherwise(F.coalesce(F.hour("__at"), F.col("__hod.m")))
    out = d.withColumns({
        "occupancy_rate": F.coalesce("occupancy_rate", "__med.rate"),
        "is_holiday": F.when(F.lower(F.col("is_holiday").cast("string")).isin("true", "1"), 1).otherwise(0).cast("bigint"),
        "day_of_week": weekday.cast("bigint"),
        "hour_of_day": hour.cast("bigint"),
        "timestamp": F.coalesce(F.col("__at"), _instant(F.col("__med.time"))),
    })
    if "is_weekend" not in df.columns:
        out = out.withColumn("is_weekend", F.when(F.col("day_of_week") >= 5, 1).otherwise(0).cast("bigint"))
    return out.drop("__at", "__med", "__dow", "__hod")


def _inside(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted_occupancy", clip(F.col("predicted_occupancy"), 0.0, 1.0))


def prediction_fills(known: DataFrame) -> DataFrame:
    """One row: the median and the most frequent version that stand for missing values of prediction records."""
    one = known.sparkSession.range(1).select(F.lit(0).alias("one"))
    one = with_row(with_row(one, median_of(_inside(known), "predicted_occupancy"), "med"), mode_of(known, "model_version"), "ver")
    return one.select(F.col("med.m").alias("median"), F.col("ver.m").alias("version"))


def fix_predictions(df: DataFrame, as_of: str, default_version: str = "v1.0", fills: DataFrame | None = None) -> DataFrame:
    """Repair prediction records; `as_of` stands for a missing prediction time. What stands for missing values comes from `fills`
    (see `prediction_fills`), by default of the records themselves."""
    d = with_row(_inside(df), prediction_fills(df) if fills is None else fills, "__fill")
    made = F.coalesce(rules.parse_time(F.col("prediction_timestamp")), F.lit(as_of).cast("timestamp"))
    meant = rules.parse_time(F.col("predicted_for_timestamp"))
    out = d.withColumns({
        "predicted_occupancy": F.coalesce("predicted_occupancy", "__fill.median"),
        "prediction_timestamp": made,
        "predicted_for_timestamp": F.coalesce(meant, made + F.expr("interval 1 hour")),
        "model_version": F.coalesce(F.col("model_version"), F.col("__fill.version"), F.lit(default_version)),
    })
    if "confidence" not in df.columns:
        out = out.withColumn("confidence", confidence(F.col("predicted_occupancy")))
    return out.drop("__fill")


def fix_raw(df: DataFrame) -> DataFrame:
    """Repair raw records in the published order: rate, total, available, time, final consistency."""
    rate, total, free = F.col("occupancy_rate"), F.col("total_spots"), F.col("available_spots")
    usable = total.isNotNull() & free.isNotNull() & (total > 0)
    again = F.when(rate.between(0, 1), rate).otherwise(F.when(usable, 1 - free / total).otherwise(rate))
    at = rules.parse_time(F.col("timestamp"))
    d = df.withColumn("occupancy_rate", clip(again, 0.0, 1.0)).withColumn("timestamp", at)
    d = with_row(d, medians_of(d, rate=rate, time=F.unix_micros("timestamp")), "__med")
    d = d.withColumn("occupancy_rate", F.coalesce("occupancy_rate", "__med.rate")).withColumn(
        "timestamp", F.coalesce(F.col("timestamp"), _instant(F.col("__med.time"))))

    good = df.where(total > 0).select("location_id", total.cast("double").alias("t"))
    local = quantiles(good.where(F.col("location_id").isNotNull()), "t", [0.5], ["location_id"]).select(
        "location_id", F.col("q")[0].alias("__local"))

    def by_location(frame: DataFrame) -> DataFrame:
        return frame.join(local, "location_id", "left").withColumn(
            "total_spots", F.when(total > 0, total.cast("double")).otherwise(F.col("__local"))).drop("__local")

    filled = by_location(df.select("location_id", "total_spots"))
    d = with_row(by_location(d), median_of(filled, "total_spots"), "__all")
    d = d.withColumn("total_spots", F.coalesce(F.col("total_spots"), F.col("__all.m"), F.lit(100.0)))
    d = d.withColumn("available_spots", F.when(
        free.isNull() | (free < 0), F.bround(total * (1 - rate))).when(free > total, total).otherwise(free.cast("double")))
    expected = rules.expected_rate(F.col("available_spots"), F.col("total_spots"))
    d = d.withColumn("occupancy_rate", F.when(F.abs(expected - rate) > rules.RATE_TOLERANCE, expected).otherwise(rate))
    return d.select(*df.columns)


def iqr_bounds(df: DataFrame, col: str, k: float) -> DataFrame:
    q = quantiles(df, col, [0.25, 0.75])
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return q.select((q1 - k * (q3 - q1)).alias("lo"), (q3 + k * (q3 - q1)).alias("hi"))


def iqr_outliers(df: DataFrame, col: str = "occupancy", k: float = 3.0) -> DataFrame:
    """Values outside k interquartile ranges: clipped for occupancy (within 0..100), else rows dropped."""
    d = with_row(df, iqr_bounds(df, col, k), "__b")
    lo, hi, v = F.col("__b.lo"), F.col("__b.hi"), F.col(col)
    out = F.coalesce((v < lo) | (v > hi), F.lit(False))
    if col == "occupancy":
        inside = F.least(F.greatest(v, F.greatest(lo, F.lit(0.0))), F.least(hi, F.lit(100.0)))
        return d.withColumn(col, F.when(out, inside).otherwise(v)).drop("__b")
    return d.where(~out).drop("__b")


def zscore_outliers(df: DataFrame, col: str = "occupancy", limit: float = 3.0) -> DataFrame:
    """Values more than `limit` population deviations away (nulls count as the median): occupancy is
    clipped to 0..100, other columns lose the rows."""
    d = with_row(df, median_of(df, col), "__med").withColumn("__f", F.coalesce(F.col(col).cast("double"), F.col("__med.m")))
    d = with_stats(d, mean=F.avg("__f"), std=F.stddev_pop("__f"))
    z = F.abs(F.try_divide(F.col("__f") - F.col("__stats.mean"), F.col("__stats.std")))
    out = F.coalesce(z > limit, F.lit(False))
    if col == "occupancy":
        return d.withColumn(col, F.when(out, clip(F.col(col), 0.0, 100.0)).otherwise(F.col(col))).drop("__med", "__f", "__stats")
    return d.where(~out).drop("__med", "__f", "__stats")


def fill_missing(df: DataFrame, numeric: str = "interpolate", key: str = "location_id", time: str = "timestamp",
                 ties: Sequence[str] = (), cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a time are dropped; numbers interpolated in time, or set to mean or median;
    categories set to their mode."""
    df = df.where(F.col(time).isNotNull())
    skip = {key, time, *ties}
    fields = [f for f in df.schema.fields if f.name not in skip and (cols is None or f.name in cols)]
    numbers = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    words = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    out = df
    if numeric == "interpolate":
        out = interpolate_time(out, [key], time, numbers, ties)
    elif numeric in ("mean", "median") and numbers:
        one = df.agg(*[F.avg(c).alias(c) for c in numbers]) if numeric == "mean" else medians_of(df, **{c: F.col(c) for c in numbers})
        out = with_row(out, one, "__fill")
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__fill.{c}")) for c in numbers}).drop("__fill")
    elif numeric not in ("mean", "median"):
        raise ValueError(f"unknown numeric strategy {numeric}")
    for c in words:
        out = with_row(out, mode_of(df, c), f"__{c}").withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}.m"))).drop(f"__{c}")
    return out


def clean_levels(df: DataFrame, level: str, regulated: str, time: str) -> DataFrame:
    """Level clipped to [0, 1]; the regulated flag holds only between 8 and 19 o'clock."""
    return df.withColumn(level, clip(F.col(level), 0.0, 1.0)).withColumn(
        regulated, F.when((F.col(regulated) == 1) & F.hour(time).between(8, 19), 1).otherwise(0).cast("bigint"))
