"""Projections, filters, predicates and record shaping."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.plans.scalars import with_stats
from tidemark.plans.series import with_ordinal


def date_range(df: DataFrame, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range; a missing bound is open."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return df


# Named ranges; anything else means seven days.
RANGES = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30)}


def relative_range(df: DataFrame, time: str, spec: str, as_of: datetime, start: datetime | None = None,
                   end: datetime | None = None, name_col: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of a named range ending at `as_of`, or of a custom range with both ends honoured."""
    if spec == "custom" and start is not None:
        lo, hi = start, end or as_of
    else:
        lo, hi = as_of - RANGES.get(spec, RANGES["7d"]), as_of
    out = date_range(df, time, lo.isoformat(sep=" "), hi.isoformat(sep=" "))
    return out if not names else out.where(F.col(name_col).isin(list(names)))


def schema_report(df: DataFrame, required: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """One row per required column: present, of the wanted type, and whether the frame has rows."""
    have = dict(df.dtypes)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in have).alias("is_present"),
            F.lit(c in have and have[c] == (types or {}).get(c, have[c])).alias("type_ok"),
        )
        for c in required
    ]
    probe = df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))
    return probe.select("has_rows", F.explode(F.array(*rows)).alias("r")).select("r.*", "has_rows")


def require(df: DataFrame, required: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """The frame itself, or an error naming what is missing."""
    have = dict(df.dtypes)
    missing = [c for c in required if c not in have]
    wrong = [f"{c}: {have[c]} is not {t}" for c, t in (types or {}).items() if c in have and have[c] != t]
    if missing or wrong:
        raise ValueError(f"missing columns {missing}; wrong types {wrong}")
    return df


def in_range(c: Column, lo: float, hi: float) -> Column:
    return F.coalesce(c.between(lo, hi), F.lit(False))


def positive(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return in_range(lat, -90, 90) & in_range(lon, -180, 180)


def bounding_box(df: DataFrame, lat: str, lon: str, south: float, north: float, west: float, east: float) -> DataFrame:
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def map_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Target columns from the first present source column; columns without a mapping are kept."""
    taken, out = set(), []
    for target, sources in aliases.items():
        hit = next((s for s in sources if s in df.columns), None)
        if hit is not None:
            out.append(F.col(hit).alias(target))
            taken.add(hit)
    rest = [F.col(c) for c in df.columns if c not in taken and c not in aliases]
    return df.select(*rest, *out)


# What stands for a missing measurement in an export.
SENTINELS = {"temperature": -999.0, "humidity": -999.0, "precipitation": 0.0, "wind_speed": -999.0, "occupancy": -999.0}


def export_form(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """ISO-8601 times in UTC and sentinels for missing values."""
    fills = {c: v for c, v in SENTINELS.items() if c in df.columns}
    return df.withColumn(time, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")).fillna(fills)


def coerce_numeric(df: DataFrame, cols: Sequence[str], drop: bool = True) -> DataFrame:
    """Text to double, unparsable to null, rows with a null dropped."""
    df = df.withColumns({c: F.col(c).try_cast("double") for c in cols})
    return df.dropna(subset=list(cols)) if drop else df


def parse_pair(text: Column) -> tuple[Column, Column]:
    """First and second number of `"a,b"`, brackets ignored; nulls if either is not a number."""
    pieces = F.split(F.translate(text, "[]()", ""), ",")
    first = F.trim(F.try_element_at(pieces, F.lit(1))).try_cast("double")
    second = F.trim(F.try_element_at(pieces, F.lit(2))).try_cast("double")
    ok = first.isNotNull() & second.isNotNull()
    return F.when(ok, first), F.when(ok, second)


def tariff_number(text: Column) -> Column:
    """`"2,50 E/h"` -> 2.5."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"([0-9.]+)", 1).try_cast("double")


def normalize_occupancy(df: DataFrame, col: str = "occupancy", capacity: str | None = "capacity") -> DataFrame:
    """Scale to 0-100 if the table exceeds 100 (by capacity, else by the maximum), then clip."""
    s = with_stats(df, top=F.max(col))
    base = F.col(capacity) if capacity and capacity in df.columns else F.col("__stats.top")
    scaled = F.when(F.col("__stats.top") > 100, F.try_divide(F.col(col), base) * 100).otherwise(F.col(col))
    return s.withColumn(col, F.when(F.col(col).isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0)))).drop("__stats")


def min_max_scale(df: DataFrame, col: str, out: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    s = with_stats(df, lo=F.min(col), hi=F.max(col))
    share = F.try_divide(F.col(col) - F.col("__stats.lo"), F.col("__stats.hi") - F.col("__stats.lo"))
    return s.withColumn(out, share * (hi - lo) + lo).drop("__stats")


HEALTH_DOCUMENT = T.StructType(
    [
        T.StructField("operations", T.StructType([T.StructField("total_count", T.LongType()),
                                                  T.StructField("success_rate", T.DoubleType())])),
        T.StructField("performance", T.StructType([T.StructField("latency_avg_ms", T.DoubleType()),
                                                   T.StructField("latency_p95_ms", T.DoubleType()),
                                                   T.StructField("latency_p99_ms", T.DoubleType()),
                                                   T.StructField("error_rate", T.DoubleType())])),
        T.StructField("connection", T.StructType([T.StructField("attempts", T.LongType()),
                                                  T.StructField("failures", T.LongType()),
                                                  T.StructField("success_rate", T.DoubleType()),
                                                  T.StructField("avg_latency_ms", T.DoubleType())])),
    ]
)


def flatten_health(df: DataFrame, doc: str, keep: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Nested health documents (JSON text) to one flat row each."""
    d = F.from_json(doc, HEALTH_DOCUMENT)
    p = df.select(*keep, d.alias("d"))
    return p.select(
        *keep,
        F.col("d.operations.total_count").alias("operations_total_count"),
        F.col("d.operations.success_rate").alias("operations_success_rate"),
        F.col("d.performance.latency_avg_ms").alias("latency_avg_ms"),
        F.col("d.performance.latency_p95_ms").alias("latency_p95_ms"),
        F.col("d.performance.latency_p99_ms").alias("latency_p99_ms"),
        F.col("d.performance.error_rate").alias("error_rate"),
        F.col("d.connection.attempts").alias("connection_attempts"),
        F.col("d.connection.failures").alias("connection_failures"),
        F.col("d.connection.success_rate").alias("connection_success_rate"),
        F.col("d.connection.avg_latency_ms").alias("connection_avg_latency_ms"),
    )


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical column names; times belong to neither."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    other = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    return numeric, other


def assign_split(df: DataFrame, time: str, ties: Sequence[str], train: float = 0.7, test: float = 0.85) -> DataFrame:
    """train / test / validation by position in the order (time, ties)."""
    o = with_ordinal(df, [], time, ties, name="__pos")
    s = with_stats(o, source=df, n=F.count(F.lit(1)))
    pos, n = F.col("__pos"), F.col("__stats.n")
    kind = F.when(pos < n * train, "train").when(pos < n * test, "test").otherwise("validation")
    return s.withColumn("split_type", kind).drop("__pos", "__stats")


def listing(tables: dict[str, DataFrame], kind: str, time: str = "timestamp", location: str | None = None,
            start: str | None = None, end: str | None = None, limit: int = 100, ties: Sequence[str] = ()) -> DataFrame:
    """Newest rows of one of the named tables, filtered by location and whole days."""
    if kind not in tables:
        raise ValueError(f"unknown kind {kind}; one of {sorted(tables)}")
    df = tables[kind]
    if location is not None:
        df = df.where(F.col("location_id") == location)
    df = date_range(df, time, start and f"{start} 00:00:00", end and f"{end} 23:59:59")
    return df.orderBy(F.col(time).desc(), *ties).limit(limit)


def drift_rows(df: DataFrame, model_id: str, as_of: str, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Storable drift rows: one score per feature and the metrics as JSON."""
    score = F.greatest(F.coalesce(F.col("ks_statistic"), F.lit(0.0)),
                       F.coalesce(F.col("distribution_difference"), F.lit(0.0)) / 100)
    body = [c for c in df.columns if c not in keys]
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(model_id), *keys, F.lit(as_of)), 256).alias("id"),
        F.lit(model_id).alias("model_id"),
        *keys,
        score.alias("drift_score"),
        *body,
        F.lit(as_of).cast("timestamp").alias("timestamp"),
        F.to_json(F.struct(*body)).alias("metadata"),
    )
