"""Joins in time and space, lookups and referential checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.geo import haversine
from tidemark.operators.aggs import cut_labels
from tidemark.plans.ordered import quantiles
from tidemark.plans.scalars import with_row
from tidemark.plans.series import interpolate_time
from tidemark.plans.spatial import nearest
from tidemark.plans.timejoin import asof_nearest, cover_product, running_cover_product
from tidemark.session import cut

WEATHER = ["temperature", "humidity", "wind_speed", "precipitation"]


def weather_hourly(weather: DataFrame, time: str = "weather_time", cols: Sequence[str] = WEATHER) -> DataFrame:
    """Mean of every measure per hour that has a reading."""
    return weather.groupBy(F.date_trunc("hour", time).alias(time)).agg(*[F.avg(c).alias(c) for c in cols])


def join_weather_hour(obs: DataFrame, weather: DataFrame, time: str = "timestamp", weather_time: str = "weather_time",
                      cols: Sequence[str] = WEATHER, location: str = "location_id", ties: Sequence[str] = ("event_id",),
                      fill: bool = True) -> DataFrame:
    """Left join on the hour; with `fill`, hours without weather are interpolated in time per location."""
    w = weather.select(F.date_trunc("hour", weather_time).alias("__hour"), *cols)
    joined = obs.withColumn("__hour", F.date_trunc("hour", time)).join(w, "__hour", "left").drop("__hour")
    return interpolate_time(joined, [location], time, cols, ties) if fill else joined


def weather_grid(weather: DataFrame, time: str = "weather_time", cols: Sequence[str] = WEATHER) -> DataFrame:
    """Hourly means on a gap-free grid; empty hours are rows of nulls."""
    hourly = weather_hourly(weather, time, cols)
    ends = hourly.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    grid = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias(time))
    return grid.join(hourly, time, "left")


def join_weather_nearest(obs: DataFrame, weather: DataFrame, time: str = "timestamp", weather_time: str = "weather_time",
                         cols: Sequence[str] = WEATHER) -> DataFrame:
    """As-of join to the nearest hour of the gap-free weather grid."""
    return asof_nearest(obs, weather_grid(weather, weather_time, cols), time, weather_time, cols)


def event_impact(obs: DataFrame, events: DataFrame, time: str = "timestamp") -> DataFrame:
    """Product of (1 + factor) over the events that cover the time, and its logarithm, which stays finite where the product does not."""
    return running_cover_product(obs, events, time, "start_time", "end_time", 1 + F.col("impact_factor"), "event_impact", log_name="log_impact")


def event_impact_near(obs: DataFrame, events: DataFrame, time: str = "timestamp", radius_km: float = 2.0) -> DataFrame:
    """The same with the factor fading over the distance to the event, clipped to [1, 3]; an event's own `impact_radius` goes before `radius_km`."""
    km = haversine(F.col("latitude"), F.col("longitude"), F.col("event_lat"), F.col("event_lon"))
    reach = F.coalesce(F.col("impact_radius"), F.lit(radius_km)) if "impact_radius" in events.columns else F.lit(radius_km)
    out = cover_product(obs, events, time, "start_time", "end_time", 1 + F.exp(-km / reach) * F.col("impact_factor"),
                        "event_impact", keys=["latitude", "longitude"])
    return out.withColumn("event_impact", F.least(F.greatest("event_impact", F.lit(1.0)), F.lit(3.0)))


# Match quality by distance in metres, two published scales.
QUALITY = ([0, 25, 50, 100, float("inf")], ["Excellent", "Good", "Fair", "Poor"])
QUALITY_FINE = ([0, 25, 50, 75, 100], ["Excellent", "Good", "Fair", "Poor"])


def match_quality(distance: Column, scale=QUALITY) -> Column:
    return cut_labels(distance, *scale)


def match_facilities(points: DataFrame, facilities: DataFrame, threshold_m: float, lat: str = "latitude", lon: str = "longitude",
                     facility: str = "facility_id") -> DataFrame:
    """Points with their nearest facility closer than the threshold, distance and quality label."""
    near = nearest(points, facilities, 1, lat, lon, facility, within_m=threshold_m).drop("rank")
    return points.join(near, [lat, lon]).withColumn("match_quality", match_quality(F.col("distance_m")))


def nearest_facilities(points: DataFrame, facilities: DataFrame, k: int = 3, lat: str = "latitude", lon: str = "longitude",
                       facility: str = "facility_id") -> DataFrame:
    """Every point with its k nearest facilities."""
    return points.join(nearest(points, facilities, k, lat, lon, facility), [lat, lon])


def match_statistics(points: DataFrame, facilities: DataFrame, threshold_m: float, lat: str = "latitude", lon: str = "longitude",
                     facility: str = "facility_id") -> DataFrame:
    """Counts, rate, spread of the matched distances and percentiles over all nearest distances."""
    all_near = cut(points.join(nearest(points, facilities, 1, lat, lon, facility), [lat, lon]).select(facility, "distance_m"))
    hit = F.col("distance_m") < threshold_m
    one = all_near.agg(
        F.count(F.lit(1)).alias("total_points"), F.count_if(hit).alias("matches_found"),
        F.countDistinct(F.when(hit, F.col(facility))).alias("unique_facilities_matched"),
        F.min(F.when(hit, F.col("distance_m"))).alias("min_distance"), F.max(F.when(hit, F.col("distance_m"))).alias("max_distance"),
        F.avg(F.when(hit, F.col("distance_m"))).alias("mean_distance"))
    one = one.withColumn("matching_rate", F.try_divide(F.col("matches_found") * 100.0, F.col("total_points")))
    median = quantiles(all_near.where(hit), "distance_m", [0.5]).select(F.col("q")[0].alias("median_distance"))
    pct = quantiles(all_near, "distance_m", [0.25, 0.5, 0.75, 0.9, 0.95]).select(
        *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75, 90, 95))])
    sized = with_row(one, facilities.agg(F.count(F.lit(1)).alias("total_facilities")), "__f")
    return with_row(with_row(sized, median, "__m"), pct, "__p").select(*one.columns, "__f.*", "__m.*", "__p.*")


def compare_methods(frames: dict[str, DataFrame], key: str = "variable", value: str = "correlation") -> DataFrame:
    """Result tables joined on the variable with the mean of their absolute values."""
    out = None
    for name, f in frames.items():
        side = f.select(key, F.col(value).alias(name))
        out = side if out is None else out.join(side, key)
    mean = sum((F.abs(F.col(n)) for n in frames), F.lit(0.0)) / len(frames)
    return out.withColumn("mean_abs", mean).orderBy(F.col("mean_abs").desc(), key)


def lookup_day(df: DataFrame, days: DataFrame, time: str, day: str, cols: Sequence[str]) -> DataFrame:
    """Columns of a day dimension by the date of the row."""
    d = days.select(F.col(day).alias("__day"), *cols)
    return df.withColumn("__day", F.to_date(time)).join(d, "__day", "left").drop("__day")


def holiday_flags(df: DataFrame, holidays: DataFrame, time: str, day: str = "holiday") -> DataFrame:
    """is_holiday and is_pre_holiday from a calendar of dates."""
    dates = holidays.select(F.col(day).alias("d")).distinct()
    marks = dates.select("d", F.lit(True).alias("h"), F.lit(False).alias("e")).unionByName(
        dates.select(F.date_sub("d", 1).alias("d"), F.lit(False).alias("h"), F.lit(True).alias("e")))
    per_day = marks.groupBy(F.col("d").alias("__day")).agg(F.bool_or("h").alias("is_holiday"), F.bool_or("e").alias("is_pre_holiday"))
    out = df.withColumn("__day", F.to_date(time)).join(per_day, "__day", "left").drop("__day")
    return out.fillna(False, ["is_holiday", "is_pre_holiday"])


def route_models(df: DataFrame, registry: DataFrame, location: str = "location_id") -> DataFrame:
    """Model of each row: the location's own (of several the largest id, as for the global one), else the global one, else none with an error text."""
    own = registry.where(F.col("location_id").isNotNull()).groupBy(F.col("location_id").alias("__loc")).agg(F.max("model_id").alias("__own"))
    world = registry.where(F.col("location_id").isNull()).agg(F.max("model_id").alias("m")).scalar()
    out = df.join(own, F.col(location) == F.col("__loc"), "left").withColumn("__global", world)
    return out.select(
        *df.columns, F.coalesce("__own", "__global").alias("model_id"),
        F.when(F.col("__own").isNotNull(), "location").when(F.col("__global").isNotNull(), "global").otherwise("none").alias("route"),
        F.when(F.coalesce("__own", "__global").isNull(), F.concat(F.lit("no model for "), F.col(location))).alias("error"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, label: str) -> DataFrame:
    """Foreign keys without a parent row: (relation, key, rows)."""
    missing = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    gone = missing.join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")
    return gone.select(F.lit(label).alias("relation"), F.col("key").cast("string").alias("key"), "rows")
