"""Grouped aggregates: profiles, pivots, bins, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import calendar
from tidemark.plans.ordered import nth, quantiles
from tidemark.plans.scalars import with_row, with_stats

# Calendar order of names.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
               "November", "December"]


def mean_std(df: DataFrame, keys: Sequence[str], value: str, count: bool = True) -> DataFrame:
    aggs = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")]
    if count:
        aggs.append(F.count(value).alias("count"))
    return df.groupBy(*keys).agg(*aggs)


def fixed_rows(df: DataFrame, names: Sequence[str], col: str) -> DataFrame:
    """One row per given name with its position."""
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(n).alias(col)) for i, n in enumerate(names)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def named_profile(df: DataFrame, time: str, value: str, by: str) -> DataFrame:
    """mean / std per day or month name, all names in calendar order, absent ones null."""
    names, pattern, col = (DAY_NAMES, "EEEE", "day_name") if by == "day" else (MONTH_NAMES, "MMMM", "month_name")
    got = mean_std(df.withColumn(col, F.date_format(time, pattern)), [col], value, count=False)
    return fixed_rows(df, names, col).join(got, col, "left")


def location_stats(df: DataFrame, time: str = "timestamp", ties: Sequence[str] = ()) -> DataFrame:
    first = F.min_by("capacity", F.struct(time, *ties))
    return df.groupBy("location_id").agg(
        F.avg("occupancy").alias("avg_occupancy"), F.stddev_samp("occupancy").alias("std_occupancy"),
        F.min("occupancy").alias("min_occupancy"), F.max("occupancy").alias("max_occupancy"), first.alias("capacity"))


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), name: str = "column_name", value: str = "v") -> DataFrame:
    """(keep, name, value as double) for the numeric columns."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(keep), list(cols), name, value)


def describe(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max of every column in one long pass."""
    u = long_form(df, cols, keys).where(F.col("v").isNotNull())
    k = [*keys, "column_name"]
    base = u.groupBy(*k).agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                             F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(u, "v", [0.25, 0.5, 0.75], k).select(*k, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
    return base.join(q, k)


def missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing"),
                     F.try_divide(F.col(c) * 100.0, F.col("n")).alias("missing_pct")) for c in cols]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share per non-null value."""
    have = df.where(F.col(col).isNotNull())
    s = with_stats(have.groupBy(col).agg(F.count(F.lit(1)).alias("count")), source=have, n=F.count(F.lit(1)))
    return s.withColumn("share", F.col("count") / F.col("__stats.n")).drop("__stats")


def summary(df: DataFrame, time: str, location: str, value: str, kinds: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(item, value as text-free double) rows of a dataset report plus counts per category."""
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("observations"), F.countDistinct(location).cast("double").alias("locations"),
        F.avg(value).alias("average"), F.min(value).cast("double").alias("lowest"), F.max(value).cast("double").alias("highest"),
        F.unix_micros(F.min(time)).cast("double").alias("first_us"), F.unix_micros(F.max(time)).cast("double").alias("last_us"),
        sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).cast("double").alias("missing"))
    out = one.unpivot([], one.columns, "item", "amount")
    for k in kinds:
        n = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).cast("double").alias("amount"))
        out = out.unionByName(n.select(F.concat(F.lit(f"{k}: "), F.col(k)).alias("item"), "amount"))
    return out


def week_profile(df: DataFrame, time: str, value: str, location: str, min_rows: int = 168) -> DataFrame:
    """Mean per hour of the week on a dense 7 x 24 grid for locations with more than `min_rows` rows."""
    slot = F.weekday(time) * 24 + F.hour(time)
    cells = df.groupBy(location, slot.alias("day_hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.count(value).alias("m"))
    big = cells.groupBy(location).agg(F.sum("n").alias("n")).where(F.col("n") > min_rows).select(location)
    grid = big.select(location, F.explode(F.sequence(F.lit(0), F.lit(167))).alias("day_hour"))
    got = cells.select(location, "day_hour", F.try_divide(F.col("s"), F.col("m")).alias("mean"))
    out = grid.join(got, [location, "day_hour"], "left")
    return out.select(location, F.floor(F.col("day_hour") / 24).alias("weekday"), (F.col("day_hour") % 24).alias("hour"),
                      F.coalesce("mean", F.lit(0.0)).alias("mean"))


def pivot(df: DataFrame, index: Sequence[str], columns: str, values: Sequence, value: str, how: str = "avg", prefix: str = "c") -> DataFrame:
    """Pivot with the column values named up front (one pass)."""
    agg = {"avg": F.avg, "count": F.count, "sum": F.sum}[how](value)
    wide = df.groupBy(*index).pivot(columns, list(values)).agg(agg)
    return wide.select(*index, *[F.col(f"`{v}`").alias(f"{prefix}_{v}") for v in values])


def crosstab(df: DataFrame, row: str, columns: str, values: Sequence, normalize: bool = False) -> DataFrame:
    counts = [F.count_if(F.col(columns) == v).alias(f"n_{v}") for v in values]
    out = df.where(F.col(row).isNotNull() & F.col(columns).isNotNull()).groupBy(row).agg(*counts)
    if not normalize:
        return out
    total = sum((F.col(f"n_{v}") for v in values), F.lit(0))
    return out.select(row, *[F.try_divide(F.col(f"n_{v}").cast("double"), total).alias(f"n_{v}") for v in values])


def cut_labels(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (edges[i], edges[i+1]]; the lowest edge itself and anything outside is null."""
    out = None
    for lo, hi, name in zip(edges, edges[1:], labels):
        hit = (c > F.lit(float(lo))) & (c <= F.lit(float(hi)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# Bands of occupancy share and blocks of the regulated day.
SHARE_BANDS = ([0, 0.25, 0.5, 0.75, 1.0], ["Low", "Medium", "High", "Very High"])
TIME_BLOCKS = ([7, 10, 13, 16, 19], ["Morning", "Midday", "Afternoon", "Evening"])


def quantile_bins(df: DataFrame, col: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """Equal-frequency bin number (right-closed, lowest edge included, duplicate edges dropped)."""
    q = quantiles(df, col, [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("edges"))
    s = with_row(df, q)
    edges = F.col("__stats.edges")
    below = F.size(F.filter(edges, lambda e: e < F.col(col)))
    return (s.withColumn(out, F.when(F.col(col).isNotNull(), F.greatest(below - 1, F.lit(0)).cast("bigint")))
            .withColumn(f"{out}_left", F.try_element_at(edges, (F.col(out) + 1).cast("int")))
            .withColumn(f"{out}_right", F.try_element_at(edges, (F.col(out) + 2).cast("int"))).drop("__stats"))


def bin_stats(binned: DataFrame, value: str, bin_col: str = "bin") -> DataFrame:
    return binned.where(F.col(bin_col).isNotNull()).groupBy(bin_col).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def width_bins(df: DataFrame, col: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """Equal-width bin number, right-closed, the minimum in the first bin."""
    s = with_stats(df, lo=F.min(col).cast("double"), hi=F.max(col).cast("double"))
    step = (F.col("__stats.hi") - F.col("__stats.lo")) / bins
    above = F.lit(0)
    for i in range(1, bins):
        above = above + F.when(F.col(col) > F.col("__stats.lo") + step * i, 1).otherwise(0)
    return s.withColumn(out, F.when(F.col(col).isNotNull(), above.cast("bigint"))).drop("__stats")


def utilization(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"),
                                 F.avg((F.col(value) > 0).cast("double")).alias("utilization_rate"))


def peak_hours(df: DataFrame, kind: str, time: str, value: str) -> DataFrame:
    """Hour with the highest mean (a tie takes the smaller hour), its mean, overall mean and utilisation."""
    h = df.groupBy(kind, F.hour(time).alias("hour")).agg(
        F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"), F.count_if(F.col(value) > 0).alias("u"))
    return h.groupBy(kind).agg(
        F.max_by("hour", F.struct("m", -F.col("hour"))).alias("peak_hour"), F.max("m").alias("peak_level"),
        F.try_divide(F.sum("s"), F.sum("n")).alias("mean_level"), F.try_divide(F.sum("u") * 100.0, F.sum("n")).alias("utilization_pct"))


def count_map(df: DataFrame, key: str, category: str) -> DataFrame:
    """Map category -> count per key, entries in category order."""
    n = df.where(F.col(category).isNotNull()).groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(category).alias("k"), F.col("n").alias("v"))))
    return n.groupBy(key).agg(F.map_from_entries(entries).alias("counts"))


def distinct_per_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted distinct values per key, for value columns that are small dimensions."""
    return df.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def table_stats(df: DataFrame, location: str, time: str) -> DataFrame:
    """Rows, distinct locations, the location list and the time range, from one row per location."""
    per = df.groupBy(location).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    return per.agg(F.sum("n").alias("total_records"), F.count(location).alias("unique_locations"),
                   F.concat_ws(",", F.sort_array(F.collect_list(location))).alias("locations"),
                   F.min("lo").alias("first_time"), F.max("hi").alias("last_time"))


def drift_history(df: DataFrame) -> DataFrame:
    return df.groupBy("feature").agg(F.count_if("drift_detected").alias("drift_count"), F.avg("p_value").alias("avg_p_value"),
                                     F.max("statistic").alias("max_statistic")).orderBy(F.col("drift_count").desc(), "feature")


def action_statistics(df: DataFrame, bins: int = 20) -> DataFrame:
    """(section, item, count, mean confidence) by type, by priority and over `bins` time bins."""
    s = with_stats(df, lo=F.min(F.unix_micros("timestamp")), hi=F.max(F.unix_micros("timestamp")))
    width = (F.col("__stats.hi") - F.col("__stats.lo")) / bins
    at = F.least(F.floor(F.try_divide(F.unix_micros("timestamp") - F.col("__stats.lo"), width)), F.lit(bins - 1))
    facets = F.array(
        F.struct(F.lit("type").alias("section"), F.col("action_type").alias("item")),
        F.struct(F.lit("priority").alias("section"), F.col("priority").cast("string").alias("item")),
        F.struct(F.lit("time").alias("section"), F.coalesce(at, F.lit(0)).cast("string").alias("item")))
    return s.select(F.explode(facets).alias("f"), "confidence").groupBy("f.section", "f.item").agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("mean_confidence"))


def operation_rollup(df: DataFrame) -> DataFrame:
    return df.groupBy("operation").agg(
        F.count(F.lit(1)).alias("query_count"), F.count_if("is_error").alias("error_count"), F.sum("duration_ms").alias("total_ms"),
        F.max_by("event_id", F.when(F.col("is_error"), F.struct("timestamp", "event_id"))).alias("last_error_id"))


def latency_stats(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and interpolated p95 / p99."""
    q = quantiles(df, value, [0.95, 0.99], keys).select(*keys, F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"))
    m = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return m.join(q, list(keys)) if keys else with_row(m, q).select("mean", "__stats.*")


def latency_stats_approx(df: DataFrame, value: str, keys: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """The same from a mergeable sketch: one map-side combined aggregation."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile_approx(value, [0.95, 0.99], accuracy).alias("q")).select(
        *keys, "mean", F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"))


def latency_rank_stats(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """p95 / p99 as the element at position int(n * p) of the sorted values."""
    def at(p):
        return F.least(F.floor(F.col("n_total") * F.lit(p)), F.col("n_total") - 1)

    return nth(df, value, {"p95": at(0.95), "p99": at(0.99)}, keys)


def availability(df: DataFrame, status: str = "status", keys: Sequence[str] = ()) -> DataFrame:
    n = F.count(F.lit(1))
    ok = F.count_if(F.col(status).isin("healthy", "degraded"))
    a = df.groupBy(*keys).agg(
        n.alias("data_points"), F.count_if(F.col(status) == "healthy").alias("healthy"),
        F.count_if(F.col(status) == "degraded").alias("degraded"), F.count_if(F.col(status) == "critical").alias("critical"),
        F.try_divide(ok.cast("double"), n).alias("availability"))
    grade = F.when(F.col("availability") > 0.98, "healthy").when(F.col("availability") > 0.9, "degraded").otherwise("critical")
    return a.withColumn("overall_status", grade)


def response_times(df: DataFrame, times: str) -> DataFrame:
    """avg / min / max per entry of a map column of response times; zeros are failed calls."""
    e = df.select(F.explode(times).alias("endpoint", "ms")).where(F.col("ms") > 0)
    return e.groupBy("endpoint").agg(F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def histograms(reference: DataFrame, current: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Share per equal-width bin of both sides; bins span the joint range of each column."""
    both = long_form(reference, cols).withColumn("side", F.lit("reference")).unionByName(
        long_form(current, cols).withColumn("side", F.lit("current"))).where(F.col("v").isNotNull())
    span = both.groupBy("column_name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    n = both.groupBy("column_name", "side").agg(F.count(F.lit(1)).alias("n"))
    pos = F.least(F.floor(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    c = both.join(span, "column_name").groupBy("column_name", "side", F.coalesce(pos, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return c.join(n, ["column_name", "side"]).select("column_name", "side", "bin", (F.col("c") / F.col("n")).alias("share"))


def missing_over_time(df: DataFrame, time: str, cols: Sequence[str], bucket: str = "day") -> DataFrame:
    per = df.groupBy(F.date_trunc(bucket, time).alias("bucket")).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return per.unpivot(["bucket"], list(cols), "feature", "missing_rate")


# Keyword groups of feature names, first match wins.
IMPORTANCE_GROUPS = {
    "time": ["hour", "day", "month", "is_weekend", "day_of_year", "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"],
    "weather": ["temperature", "humidity", "precipitation", "wind_speed"],
    "location": ["location_id", "zone_type", "capacity"],
    "traffic": ["traffic_level"],
}


def importance_by_group(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    name, group = F.lower(feature), None
    for g, words in IMPORTANCE_GROUPS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(name, F.lit(w))
        group = F.when(hit, g) if group is None else group.when(hit, g)
    return df.withColumn("category", group).where(F.col("category").isNotNull()).groupBy("category").agg(F.sum(importance).alias("importance"))


def error_profile(df: DataFrame, actual: str = "actual", predicted: str = "predicted", time: str = "timestamp",
                  location: str = "location_id", bins: int = 10) -> DataFrame:
    """Mean, std and count of the absolute error by hour, weekday, weekend, location and level bin."""
    b = width_bins(df, actual, bins, "__bin").withColumn("abs_error", F.abs(F.col(actual) - F.col(predicted)))
    facets = F.array(*[
        F.struct(F.lit(n).alias("facet"), c.cast("string").alias("item")) for n, c in (
            ("hour", F.hour(time)), ("weekday", F.weekday(time)), ("weekend", calendar.is_weekend(F.col(time))),
            ("location", F.col(location)), ("level", F.col("__bin")))])
    return b.select(F.explode(facets).alias("f"), "abs_error").groupBy("f.facet", "f.item").agg(
        F.avg("abs_error").alias("mean_error"), F.stddev_samp("abs_error").alias("std_error"), F.count("abs_error").alias("count"))


def zero_profile(df: DataFrame, time: str, level: str) -> DataFrame:
    """Zero and non-zero readings per hour with the operational flag of the hour."""
    h = F.hour(time)
    return df.groupBy(h.alias("hour"), calendar.operational(h).alias("is_operational")).agg(
        F.count_if(F.col(level) == 0).alias("zero"), F.count_if(F.col(level) != 0).alias("non_zero"),
        F.count_if((F.col(level) != 0) & ~calendar.operational(h)).alias("non_zero_outside"))


def boundary_profile(df: DataFrame, time: str, level: str, hours: Sequence[int] = (6, 7, 18, 19), levels: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """Readings per minute of the day around opening and closing, by level, with the mean level."""
    return df.where(F.hour(time).isin(list(hours))).groupBy((F.hour(time) * 60 + F.minute(time)).alias("minute_of_day")).agg(
        *[F.count_if(F.col(level) == v).alias(f"level_{v}") for v in levels], F.avg(level).alias("mean_level"))
