"""Feature tables built from the expression modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import calendar, demand, weather
from tidemark.functions.constants import LEVELS
from tidemark.plans.ordered import sorted_codes
from tidemark.plans.scalars import with_stats


def calendar_features(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.withColumns(calendar.parts(F.col(time)))


def weather_features(df: DataFrame) -> DataFrame:
    """Bands and non-linear terms of the weather columns that are present."""
    cols: dict[str, Column] = {}
    if "humidity" in df.columns:
        df = with_stats(df, top=F.max("humidity"))
        cols |= weather.humidity_bands(F.col("humidity"), F.col("__stats.top"))
    if "precipitation" in df.columns:
        cols |= weather.rain_bands(F.col("precipitation"))
    if "temperature" in df.columns:
        cols |= weather.temperature_bands(F.col("temperature"), F.col("humidity") if "humidity" in df.columns else None)
    return df.withColumns(cols).drop("__stats")


def time_features(df: DataFrame, time: str = "timestamp") -> DataFrame:
    ts = F.col(time)
    half = calendar.cycle(F.hour(ts), 12)
    return df.withColumns(
        {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "is_weekend": calendar.is_weekend(ts)}
        | calendar.period_flags(F.hour(ts), calendar.is_weekend(ts))
        | calendar.day_flags(F.weekday(ts))
        | {"hour_sin_halfday": half[0], "hour_cos_halfday": half[1]}
        | calendar.offsets(ts)
    )


def utilization_features(df: DataFrame, occupancy: str = "occupancy", capacity: str = "capacity") -> DataFrame:
    u = F.try_divide(F.col(occupancy), F.col(capacity))
    return df.withColumns(
        {
            "utilization_pct": u,
            "low_utilization": calendar.flag(u < 0.3),
            "medium_utilization": calendar.flag((u >= 0.3) & (u < 0.7)),
            "high_utilization": calendar.flag(u >= 0.7),
        }
    )


# One column per category value is only sensible for small categories.
MAX_CATEGORIES = 1000


def categories(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct values of a small category column; more than MAX_CATEGORIES is an error."""
    found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{col} has more than {MAX_CATEGORIES} values: not a category to spread into columns")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """0/1 column `col_value` for every category value."""
    values = categories(df, col) if values is None else values
    return df.withColumns({f"{col}_{v}": calendar.flag(F.col(col) == v) for v in values})


# Which columns interact.
TIME_TERMS = ["morning_peak", "midday", "evening_peak", "night", "is_weekend"]
WEATHER_TERMS = ["temperature", "humidity", "precipitation", "heavy_rain", "temp_hot"]
PLACE_TERMS = ["location_cluster", "parking_type"]
PLACE_TIME_TERMS = ["morning_peak", "evening_peak", "is_weekend"]
PLACE_WEATHER_TERMS = ["heavy_rain", "temp_hot"]


def interactions(df: DataFrame, values: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Products `a_b` of time x weather and place x (time, weather) columns that are present."""
    def num(c: str) -> Column:
        return F.col(c).cast("bigint") if isinstance(df.schema[c].dataType, T.BooleanType) else F.col(c)

    have = set(df.columns)
    cols: dict[str, Column] = {}
    for t in TIME_TERMS:
        for w in WEATHER_TERMS:
            if t in have and w in have:
                cols[f"{t}_{w}"] = num(t) * num(w)
    for place in PLACE_TERMS:
        if place not in have:
            continue
        if isinstance(df.schema[place].dataType, T.StringType):
            vals = (values or {}).get(place) or categories(df, place)
            sides = {f"{place}_{v}": calendar.flag(F.col(place) == v) for v in vals}
        else:
            sides = {place: F.col(place)}
        for other in PLACE_TIME_TERMS + PLACE_WEATHER_TERMS:
            if other in have:
                for name, side in sides.items():
                    cols[f"{name}_{other}"] = side * num(other)
    return df.withColumns(cols)


def advanced(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Weather, time, utilisation, one-hot and interaction features in the published order."""
    out = utilization_features(time_features(weather_features(df), time))
    kinds = categories(df, "parking_type") if "parking_type" in df.columns else []
    if kinds:
        out = one_hot(out, "parking_type", kinds)
    return interactions(out, {"parking_type": kinds} if kinds else None)


def label_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """Code of the category in sorted order, null as -1; the category may have any number of values."""
    codes = sorted_codes(df, col, "__code")
    return df.join(codes, col, "left").withColumn(out, F.coalesce("__code", F.lit(-1).cast("bigint"))).drop("__code")


def level_labels(level: Column) -> Column:
    out = None
    for n, text in LEVELS.items():
        out = F.when(level == n, text) if out is None else out.when(level == n, text)
    return out


def rule_scores(df: DataFrame, weights: dict[str, float] = demand.RULE_WEIGHTS, out: str = "score") -> DataFrame:
    """Rule-model occupancy of rows with place, time and weather columns."""
    w = weather.factor(F.col("temperature"), F.col("humidity"), F.col("wind_speed"), F.col("precipitation"), F.month("timestamp"))
    parts = demand.rule_components(F.col("parking_type"), F.col("timestamp"), F.col("latitude"), F.col("longitude"),
                                   F.col("capacity"), w)
    return df.withColumn(out, demand.rule_score(parts, weights))
