"""Window and time-series operators; no task's rows grow with a key (see plans.series)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.plans.ordered import sorted_codes, with_group_stats
from tidemark.plans.ranks import Ranks
from tidemark.plans.series import (
    BLOCK, ORDINAL, alike, fill_forward_back, interpolate_time, row_frame, running_counts, sliding, whole, with_ordinal,
)
from tidemark.plans.slices import largest, needed
from tidemark.session import cut

LAGS = {"1h": 1, "2h": 2, "24h": 24}


def lags(df: DataFrame, keys: Sequence[str], time: str, value: str, steps: dict[str, int], ties: Sequence[str] = ()) -> DataFrame:
    """`value_lag_name` columns: the value so many rows earlier in the key's order."""
    return row_frame(df, keys, time, lambda w: {f"{value}_lag_{n}": F.lag(value, k).over(w) for n, k in steps.items()},
                     ties, before=max(steps.values()))


def minute_lags(df: DataFrame, keys: Sequence[str], time: str, value: str, minutes: Sequence[int] = (5, 10, 15),
                step: int = 5, ties: Sequence[str] = ()) -> DataFrame:
    return lags(df, keys, time, value, {str(m): m // step for m in minutes}, ties)


def trailing_rows(df: DataFrame, keys: Sequence[str], time: str, value: str, rows: int = 3, ties: Sequence[str] = (),
                  prefix: str | None = None) -> DataFrame:
    """Mean and sample std of the last `rows` rows, null until there are that many."""
    def compute(w):
        f = w.rowsBetween(-(rows - 1), 0)
        full = F.count(value).over(f) == rows
        p = prefix or f"{value}_rolling"
        return {f"{p}_mean_{rows}": F.when(full, F.avg(value).over(f)), f"{p}_std_{rows}": F.when(full, F.stddev_samp(value).over(f))}

    return row_frame(df, keys, time, compute, ties, before=rows - 1)


def fill(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], ties: Sequence[str] = (), back_first: bool = False) -> DataFrame:
    return fill_forward_back(df, keys, time, cols, ties, back_first)


def interpolate(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    return interpolate_time(df, keys, time, cols, ties)


def lag_features(df: DataFrame, time: str = "timestamp", key: str = "location_id", value: str = "occupancy",
                 ties: Sequence[str] = ()) -> DataFrame:
    """Lags 1, 2 and 24 and three-row statistics, then backward and forward fill of the new columns."""
    out = trailing_rows(lags(df, [key], time, value, LAGS, ties), [key], time, value, 3, ties)
    return fill(out, [key], time, [c for c in out.columns if c not in df.columns], ties, back_first=True)


def regular_grid(df: DataFrame, key: str, time: str, numeric: Sequence[str], categorical: Sequence[str], step: str = "1 hour") -> DataFrame:
    """Every step between a key's first and last time; numeric gaps interpolated, categories carried."""
    ends = df.groupBy(key).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    grid = ends.select(key, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(time))
    full = grid.join(df, [key, time], "left")
    return fill_forward_back(interpolate_time(full, [key], time, numeric), [key], time, categorical)


def resample(df: DataFrame, time: str, cols: Sequence[str], unit: str = "hour") -> DataFrame:
    """Mean per time unit including empty units."""
    means = df.groupBy(F.date_trunc(unit, time).alias(time)).agg(*[F.avg(c).alias(c) for c in cols])
    ends = means.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    grid = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias(time))
    return grid.join(means, time, "left")


def smooth_anomalies(df: DataFrame, key: str, time: str, value: str, threshold: float = 3.0, ties: Sequence[str] = ()) -> DataFrame:
    """Values more than `threshold` sample deviations from the key's mean are interpolated away."""
    s = with_group_stats(df, [key], __m=F.avg(value), __s=F.stddev_samp(value))
    z = F.abs(F.try_divide(F.col(value) - F.col("__m"), F.col("__s")))
    s = s.withColumn("is_anomaly", F.coalesce(z > threshold, F.lit(False)))
    s = s.withColumn(value, F.when(~F.col("is_anomaly"), F.col(value))).drop("__m", "__s")
    return interpolate_time(s, [key], time, [value], ties)


def flag_anomalies(df: DataFrame, keys: Sequence[str], value: str, population: bool, threshold: float = 3.0,
                   out: str = "z_score") -> DataFrame:
    """z-score within the group: sample deviation with a floor of 1e-10, or population deviation."""
    std = F.stddev_pop(value) if population else F.stddev_samp(value)
    s = with_group_stats(df, keys, __m=F.avg(value), __s=std)
    base = F.col("__s") if population else F.greatest(F.col("__s"), F.lit(1e-10))
    z = F.try_divide(F.col(value) - F.col("__m"), base)
    return s.withColumn(out, z).withColumn(f"{out}_flag", F.coalesce(F.abs(z) > threshold, F.lit(False))).drop("__m", "__s")


def corrected_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population one; null below three values."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; null below four values."""
    return F.when(n >= 4, F.try_divide((n - 1.0), (n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))


def rolling_moments(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: int = 24) -> DataFrame:
    """Trailing mean, sample std, min, max, count, corrected skew and kurtosis over (t - hours, t]."""
    centred = with_group_stats(df, keys, __mid=F.avg(value))
    y = F.col(value) - F.col("__mid")
    s = sliding(
        centred, keys, time, hours * 3600,
        {"__n": F.when(y.isNotNull(), 1).otherwise(0).cast("bigint"), "__1": y, "__2": y * y, "__3": y * y * y, "__4": y * y * y * y},
        extremes={"min": (F.col(value), "min"), "max": (F.col(value), "max")}, parts=hours)
    n = F.col("__n").cast("double")
    m = F.try_divide(F.col("__1"), n)
    e2, e3, e4 = (F.try_divide(F.col(f"__{p}"), n) for p in (2, 3, 4))
    # central moments from the sums about the key's mean
    c2 = F.greatest(e2 - m * m, F.lit(0.0))
    c3 = e3 - 3 * m * e2 + 2 * m * m * m
    c4 = e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m
    some = F.when(c2 > 1e-12, c2)
    return s.withColumns({
        "count": F.col("__n"),
        "mean": m + F.col("__mid"),
        "std": F.when(n >= 2, F.sqrt(F.try_divide(c2 * n, n - 1))),
        "skew": corrected_skew(n, c3 / F.pow(some, 1.5)),
        "kurtosis": corrected_kurtosis(n, c4 / (some * some) - 3),
    }).drop("__mid", "__n", "__1", "__2", "__3", "__4")


#: Bits of a value's code that one level of the percentile search decides.
DIGIT = 4
#: Rows of one key and span up to which a task takes the rows of a piece and of the span before it, and rows that a piece of several spans holds.
SPAN_ROWS, PIECE_ROWS = 500_000, 250_000
#: Times of a piece that ask at once.
ASKS = 1 << 16


def span_rows(df: DataFrame, keys: Sequence[str], time: str, hours: int) -> int:
    """Rows of the key and span of so many hours that has most."""
    spans = df.select(*keys, whole(F.unix_micros(time), hours * 3600 * 1_000_000).alias("__span"))
    return largest(spans.where(F.col("__span").isNotNull()), [*keys, "__span"])[0]


def rolling_percentiles(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: int = 24,
                        percentiles: Sequence[float] = (0.25, 0.5, 0.75, 0.95), most: int | None = None) -> DataFrame:
    """Exact trailing percentiles over (t - hours, t]; no row reads its frame.

    Where no key has more than SPAN_ROWS rows in a span (`most`, if already known), a task takes some spans of a key and the span before
    them; else the ranks of all rows are searched together, digit by digit. Both give the same results."""
    most = span_rows(df, keys, time, hours) if most is None else most
    if most > SPAN_ROWS:
        return _percentiles_by_digit(df, keys, time, value, hours, percentiles)
    return _percentiles_by_piece(df, keys, time, value, hours, percentiles, max(1, PIECE_ROWS // max(most, 1)))


def _percentiles_by_piece(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: int, percentiles: Sequence[float], spans: int) -> DataFrame:
    """Time is cut into pieces of so many spans; a piece gets the values of the span before it, so every frame lies in one task."""
    reach = hours * 3600 * 1_000_000
    us = F.unix_micros(time)
    span = whole(us, reach)
    # rows without a time ask nothing and are dealt to any piece
    home = F.coalesce(whole(span, spans), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1000)))
    flow = df.withColumns({"__us": us, "__v": F.col(value).cast("double"), "__home": home})
    flow = flow.withColumn("__piece", F.explode(F.array_distinct(F.array("__home", F.coalesce(whole(span + 1, spans), "__home")))))
    own = F.col("__piece") == F.col("__home")
    flow = flow.where(own | F.col("__v").isNotNull())
    columns, names = df.columns, [f"percentile_{round(p * 100)}" for p in percentiles]
    # what a piece gets from the span before is its keys, times and values
    flow = flow.select(*keys, "__piece", "__us", "__v", own.alias("__own"), *[F.when(own, F.col(f"`{c}`")).alias(c) for c in df.columns if c not in keys])

    def run(table: pa.Table) -> pa.Table:
        mine = table.column("__own").combine_chunks()
        timed, known = table.column("__us").is_valid().to_numpy(), table.column("__v").is_valid().to_numpy()
        at, v = table.column("__us").fill_null(0).to_numpy(), table.column("__v").fill_null(0).to_numpy()
        known &= timed
        order = np.argsort(at[known], kind="stable")
        t, ranks = at[known][order], Ranks(v[known][order])
        ours = mine.to_numpy(zero_copy_only=False)
        asked, back = np.unique(at[ours], return_inverse=True)
        lo, hi = np.searchsorted(t, asked - reach, "right"), np.searchsorted(t, asked, "right")
        found = np.zeros((len(percentiles), len(asked)))
        filled = np.flatnonzero(hi > lo)
        for k in range(0, len(filled), ASKS):
            some = filled[k : k + ASKS]
            a, b = lo[some], hi[some]
            for i, p in enumerate(percentiles):
                place = p * (b - a - 1)
                first = np.floor(place).astype(np.int64)
                low, high = ranks.at(a, b, first), ranks.at(a, b, np.ceil(place).astype(np.int64))
                found[i, some] = low + (high - low) * (place - first)
        none = ((hi <= lo)[back]) | ~timed[ours]
        out = table.filter(mine).select(columns)
        for n, x in zip(names, found):
            out = out.append_column(n, pa.array(x[back], mask=none))
        return out

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return flow.groupBy(*keys, "__piece").applyInArrow(run, schema)


def _percentiles_by_digit(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: int, percentiles: Sequence[float]) -> DataFrame:
    """Values get codes in sorted order. A rank is found digit by digit of its code, from the top: within the block of values that share
    the digits found so far, running counts of what entered and what left give how many rows of the frame have each next digit, and
    those counts name the digit and the rank inside the smaller block. A level costs one sort of entries, leavings and asks; there
    are as many levels as the number of distinct values has digits. Rows of one time ask once."""
    reach, fan = hours * 3600 * 1_000_000, 1 << DIGIT
    base = df.withColumn("__us", F.unix_micros(time))
    known = base.where(F.col(value).isNotNull() & F.col("__us").isNotNull())
    codes = sorted_codes(known, value, "__code")
    levels = 1
    while fan**levels < codes.count():
        levels += 1
    data = cut(known.groupBy(*keys, "__us", value).agg(F.count(F.lit(1)).alias("__n")).join(codes, value).select(*keys, F.col("__us").alias("__at"), "__code", "__n"))
    parts = needed(data, keys)
    cums = [f"__c{d}" for d in range(fan)]

    def level(asks: DataFrame, shift: int, *payload: str) -> DataFrame:
        """asks with counts: rows of their frame and block whose digit is at most d."""
        digit = F.shiftright("__code", shift).bitwiseAND(fan - 1)
        enter = data.select(*keys, F.shiftright("__code", shift + DIGIT).alias("__block"), "__at", *[F.when(digit <= d, F.col("__n")).otherwise(F.lit(0)).alias(c) for d, c in enumerate(cums)])
        leave = enter.select(*keys, "__block", (F.col("__at") + reach).alias("__at"), *[(-F.col(c)).alias(c) for c in cums])
        asked = asks.select(*keys, "__block", "__at", F.lit(True).alias("__ask"), *payload)
        flow = enter.unionByName(leave).unionByName(asked, allowMissingColumns=True)
        return running_counts(flow, [*keys, "__block"], "__at", cums, parts, F.coalesce("__ask", F.lit(False))).drop("__ask")

    def descend(counted: DataFrame) -> DataFrame:
        """The block and rank one digit further down."""
        # running counts grow with the digit: the digits whose rows all rank lower come first
        passed = F.filter(F.array(*cums[:-1]), lambda c: c <= F.col("__rank"))
        below, child = F.coalesce(F.get(passed, F.size(passed) - 1), F.lit(0)), F.size(passed)
        return counted.select(*keys, "__at", "__size", "__want", (F.col("__block") * fan + child).alias("__block"), (F.col("__rank") - below).alias("__rank"))

    place = lambda p: F.lit(float(p)) * (F.col("__size") - 1)
    asks = base.where(F.col("__us").isNotNull()).select(*keys, F.col("__us").alias("__at")).distinct().withColumn("__block", F.lit(0).cast("bigint"))
    top = level(asks, DIGIT * (levels - 1)).withColumn("__size", F.col(cums[-1])).where("__size > 0")
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("bigint") for p in percentiles for f in (F.floor, F.ceil)]))
    found = descend(top.withColumn("__want", F.explode(ranks)).withColumn("__rank", F.col("__want")))
    for k in range(levels - 2, -1, -1):
        found = descend(level(cut(found) if parts > 1 else found, DIGIT * k, "__size", "__want", "__rank"))
    named = found.join(codes.withColumnsRenamed({value: "__value", "__code": "__block"}), "__block")
    one = named.groupBy(*keys, "__at").agg(F.max("__size").alias("__size"), F.map_from_entries(F.collect_list(F.struct("__want", F.col("__value").cast("double")))).alias("__m"))
    low = lambda p: F.element_at("__m", F.floor(place(p)).cast("bigint"))
    high = lambda p: F.element_at("__m", F.ceil(place(p)).cast("bigint"))
    one = one.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__at", *[(low(p) + (high(p) - low(p)) * (place(p) - F.floor(place(p)))).alias(f"percentile_{round(p * 100)}") for p in percentiles])
    return base.join(one, (F.col("__us") == F.col("__at")) & alike(keys, "__k"), "left").drop("__us", "__at", *[f"__k{i}" for i in range(len(keys))])


def rolling_stats(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: int = 24,
                  percentiles: Sequence[float] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Trailing moments, extremes, median and percentiles over (t - hours, t]."""
    most = span_rows(df, keys, time, hours)  # before the moments, which would be computed once more for it
    out = rolling_percentiles(rolling_moments(df, keys, time, value, hours), keys, time, value, hours, sorted({0.5, *percentiles}), most)
    return out.withColumn("median", F.col("percentile_50"))


def ewm(df: DataFrame, keys: Sequence[str], time: str, value: str, alpha: float = 0.1, ties: Sequence[str] = ()) -> DataFrame:
    """Exponentially weighted mean and unbiased std with adjusted weights.

    Inside a block the weight (1-alpha)^age of a row is written as decay^-position, so running sums
    give all terms. The halo reaches back until weights vanish below double precision, and the block
    length keeps decay^(-2 position) within the range of doubles."""
    digits = -math.log10(1.0 - alpha)
    before, size = math.ceil(17 / digits), math.floor(110 / digits)
    decay = 1.0 - alpha
    centred = with_group_stats(df, keys, __mid=F.avg(value))
    y = (F.col(value) - F.col("__mid")).cast("double")

    def compute(w):
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        g = F.pow(F.lit(1.0 / decay), (F.col(ORDINAL) - F.col(BLOCK) * size).cast("double"))
        return {"__w": F.sum(g).over(upto), "__ww": F.sum(g * g).over(upto), "__wy": F.sum(g * y).over(upto),
                "__wyy": F.sum(g * y * y).over(upto)}

    o = row_frame(centred, keys, time, compute, ties, before=before, block_rows=size)
    m = F.col("__wy") / F.col("__w")
    var = F.greatest(F.col("__wyy") / F.col("__w") - m * m, F.lit(0.0))
    spread = 1.0 - F.col("__ww") / (F.col("__w") * F.col("__w"))
    return o.withColumn("ewm_mean", m + F.col("__mid")).withColumn(
        "ewm_std", F.when(spread > 1e-12, F.sqrt(var / spread))).drop("__mid", "__w", "__ww", "__wy", "__wyy")


def rolling_trend(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: int = 24, ties: Sequence[str] = ()) -> DataFrame:
    """Correlation of the value with the row position over (t - hours, t]; null without variance.

    Positions count from the start of the row's span of `hours`; for the next span they are negative. The numbered rows are written
    once, as the sums, the sizes and the key's mean all read them."""
    width = hours * 3600 * 1_000_000
    o = cut(with_ordinal(df, keys, time, ties).withColumn("__blk", whole(F.unix_micros(time), width)))
    o = with_group_stats(with_group_stats(o, keys, __mid=F.avg(value)), [*keys, "__blk"], __base=F.min(ORDINAL), __size=F.count(F.lit(1)))
    y, x = F.col(value) - F.col("__mid"), (F.col(ORDINAL) - F.col("__base")).cast("double")
    past = x - F.col("__size")
    s = sliding(o, keys, time, hours * 3600,
                {"__n": F.lit(1).cast("bigint"), "__x": x, "__y": y, "__yy": y * y, "__xy": x * y}, leaving={"__x": past, "__xy": past * y})
    n = F.col("__n").cast("double")
    cov = F.col("__xy") - F.col("__x") * F.col("__y") / n
    vx = n * (n * n - 1) / 12  # consecutive positions
    vy = F.col("__yy") - F.col("__y") * F.col("__y") / n
    r = F.when((n >= 2) & (vy > 1e-9), cov / F.sqrt(vx * vy))
    return s.withColumn("trend_correlation", r).select(*df.columns, "trend_correlation")


def rate_of_change(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: int = 24) -> DataFrame:
    """(last - first) / window hours over (t - hours, t], null below two rows."""
    s = sliding(df, keys, time, hours * 3600, {"__n": F.lit(1).cast("bigint")}, firsts={"__first": F.col(value)}, parts=hours)
    rate = F.when(F.col("__n") >= 2, (F.col(value) - F.col("__first")) / F.lit(float(hours)))
    return s.withColumn("rate_of_change", rate).drop("__n", "__first")


def volatility(df: DataFrame, keys: Sequence[str], time: str, value: str, hours: int = 24, ties: Sequence[str] = ()) -> DataFrame:
    """Sample std of the relative change from row to row over (t - hours, t], at least two changes."""
    prev = row_frame(df, keys, time, lambda w: {"__prev": F.lag(value).over(w)}, ties, before=1)
    r = F.try_divide(F.col(value), F.col("__prev")) - 1
    s = sliding(prev, keys, time, hours * 3600,
                {"__n": F.when(r.isNotNull(), 1).otherwise(0).cast("bigint"), "__r": r, "__rr": r * r}, parts=hours)
    n = F.col("__n").cast("double")
    var = F.try_divide(F.col("__rr") - F.try_divide(F.col("__r") * F.col("__r"), n), n - 1)
    return s.withColumn("volatility", F.when(n >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))).select(*df.columns, "volatility")


UNITS = {"hourly": "hour", "daily": "day", "weekly": "week"}


def performance_trend(df: DataFrame, keys: Sequence[str], time: str, value: str, unit: str = "daily", rows: int = 7) -> DataFrame:
    """Mean per unit, rolling mean / std of the last rows units, first difference of the rolling mean."""
    base = df.groupBy(*keys, F.date_trunc(UNITS[unit], time).alias("period")).agg(F.avg(value).alias("value"), F.count(value).alias("sample_size"))
    rolled = trailing_rows(base, keys, "period", "value", rows, prefix="rolling").withColumnsRenamed(
        {f"rolling_mean_{rows}": "rolling_mean", f"rolling_std_{rows}": "rolling_std"})
    return row_frame(rolled, keys, "period", lambda w: {
        "trend": F.coalesce(F.col("rolling_mean") - F.lag("rolling_mean").over(w), F.lit(0.0))}, before=1)


def slot_smoothing(df: DataFrame, slot: str, value: str, width: int = 12) -> DataFrame:
    """Centred moving average of the slot profile (one row per slot of the day), null unless full."""
    profile = df.groupBy(slot).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    # at most as many rows as a day has slots
    w = Window.orderBy(slot).rowsBetween(-(width // 2), width - width // 2 - 1)
    return profile.withColumn("smoothed", F.when(F.count("mean").over(w) == width, F.avg("mean").over(w)))


def value_changes(df: DataFrame, keys: Sequence[str], time: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Previous value, change and change flag (the first row counts as changed)."""
    out = row_frame(df, keys, time, lambda w: {"previous": F.lag(value).over(w)}, ties, before=1)
    return out.withColumn("change", F.col(value) - F.col("previous")).withColumn(
        "changed", F.coalesce(F.col("change") != 0, F.lit(True)))


def transitions(changes: DataFrame, value: str) -> DataFrame:
    return changes.where(F.col("previous").isNotNull()).groupBy("previous", value).agg(F.count(F.lit(1)).alias("count"))


def moving_average(df: DataFrame, keys: Sequence[str], time: str, value: str, width: int = 3, ties: Sequence[str] = ()) -> DataFrame:
    """Centred sum over `width` rows divided by `width`; beyond the ends counts as zero."""
    ahead, back = (width - 1) // 2, width // 2
    return row_frame(df, keys, time, lambda w: {"smoothed": F.sum(value).over(w.rowsBetween(-back, ahead)) / width}, ties,
                     before=back, after=ahead)


def latest(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """Newest row per key as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, *ties)).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


# Metrics where more is better, and the changes that count as degradation.
HIGHER_BETTER = ["accuracy", "f1", "precision", "recall", "r2"]
LOWER_BETTER = ["rmse", "mae"]
DROP_LIMIT, INCREASE_LIMIT = 0.05, 0.1


def degradation(df: DataFrame, keys: Sequence[str], time: str, metric: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Each run against the previous one: drop of higher-better or relative increase of lower-better metrics."""
    out = row_frame(df, [*keys, metric], time, lambda w: {"previous": F.lag(value).over(w)}, ties, before=1)
    d = F.when(F.col(metric).isin(HIGHER_BETTER), F.col("previous") - F.col(value)).when(
        F.col(metric).isin(LOWER_BETTER), F.try_divide(F.col(value) - F.col("previous"), F.col("previous")))
    limit = F.when(F.col(metric).isin(HIGHER_BETTER), DROP_LIMIT).otherwise(INCREASE_LIMIT)
    return out.withColumn("deterioration", d).withColumn("degraded", F.coalesce(d > limit, F.lit(False)))


def complete_windows(df: DataFrame, time: str, days: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """Number each row's window of `days` distinct dates; the incomplete last window is left out."""
    d = df.withColumn("__date", F.to_date(time))
    dates = d.select(*keys, "__date").distinct()
    # one row per date and key
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__date")) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    numbered = dates.select(*keys, "__date", F.floor(rank / days).alias("window_idx"), total.alias("__total"))
    whole = numbered.where((F.col("window_idx") + 1) * days <= F.col("__total"))
    bounds = whole.groupBy(*keys, "window_idx").agg(F.min("__date").alias("window_start"), F.max("__date").alias("window_end"))
    return d.join(whole.drop("__total").join(bounds, [*keys, "window_idx"]), [*keys, "__date"]).drop("__date")


def trend_slopes(df: DataFrame, key: str, order: str, cols: Sequence[str], min_points: int = 3) -> DataFrame:
    """Least-squares slope per key against the rank of the point (0, 1, ...), keys with enough points."""
    ranked = df.withColumn("__i", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("double"))
    g = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("points"), *[F.regr_slope(c, F.lit(1.0) * F.col("__i")).alias(f"{c}_slope") for c in cols])
    return g.where(F.col("points") >= min_points)


def degradation_trends(df: DataFrame, key: str = "model", order: str = "window_idx", rmse_limit: float = 0.1, r2_limit: float = -0.05) -> DataFrame:
    t = trend_slopes(df, key, order, ["rmse", "r2"])
    return t.withColumn("degrading", (F.col("rmse_slope") > rmse_limit) | F.coalesce(F.col("r2_slope") < r2_limit, F.lit(False)))


def sequences(df: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], target: str, length: int = 24,
              ties: Sequence[str] = ()) -> DataFrame:
    """Feature history of the `length` rows before each row and the row's target."""
    hist = F.struct(*[F.col(c) for c in features])
    out = row_frame(df, keys, time, lambda w: {"history": F.collect_list(hist).over(w.rowsBetween(-length, -1))}, ties, before=length)
    return out.where(F.size("history") == length).withColumn("target", F.col(target))


def newest(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], n: int = 1000) -> DataFrame:
    """Newest n rows per key."""
    o = with_ordinal(df, keys, time, ties)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return o.join(sizes, list(keys)).where(F.col(ORDINAL) >= F.col("__n") - n).drop(ORDINAL, "__n")


def recent_error_rate(df: DataFrame, key: str, time: str, error: str, minutes: int = 5) -> DataFrame:
    """Requests and error rate over [t - minutes, t] per key."""
    s = sliding(df, [key], time, minutes * 60,
                {"request_count": F.lit(1).cast("bigint"), "__errors": F.col(error).cast("bigint")}, open_left=False)
    return s.withColumn("recent_error_rate", F.col("__errors") / F.col("request_count")).drop("__errors")


def metric_change(df: DataFrame, keys: Sequence[str], time: str, metric: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Percent change to the previous value and whether it is an improvement for the metric's direction."""
    out = row_frame(df, [*keys, metric], time, lambda w: {"previous": F.lag(value).over(w)}, ties, before=1)
    pct = F.try_divide(F.col(value) - F.col("previous"), F.abs("previous")) * 100
    better = F.when(F.col(metric).isin(HIGHER_BETTER), F.col(value) > F.col("previous")).otherwise(F.col(value) < F.col("previous"))
    return out.withColumn("change_pct", pct).withColumn("is_improvement", better)
