"""The preparation of observations as one job: from raw rows with gaps and outliers to a model table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions import calendar
from tidemark.operators import joins, repair, shaping, windows
from tidemark.session import cut
from tidemark.plans.series import fill_forward_back, interpolate_time


def kinds(df: DataFrame, skip: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    return ([f.name for f in fields if isinstance(f.dataType, T.NumericType)], [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))])


def prepare(obs: DataFrame, weather: DataFrame, holidays: DataFrame, key: str = "location_id", time: str = "timestamp", value: str = "occupancy",
            step: str = "1 hour") -> DataFrame:
    """Eight steps: outliers clipped at three interquartile ranges; missing numbers interpolated and missing categories set to the
    mode; a regular grid per location; anomalies (three deviations) interpolated away; weather of the hour joined and its gaps
    interpolated; calendar columns; occupancy scaled to 0-100; what is still missing filled from the neighbours in time.

    obs: one row per location and step, key, time, value and further columns, among them perhaps `capacity`. holidays: a date column
    `holiday`. Rows without a time are dropped. Fills never cross locations. The table is written twice on the way, where the next step
    would otherwise compute everything before it several times."""
    clipped = repair.iqr_outliers(obs, value)
    filled = cut(repair.fill_missing(clipped, key=key, time=time))
    numeric, categorical = kinds(filled, (key, time))
    grid = windows.regular_grid(filled, key, time, numeric, categorical, step)
    smooth = windows.smooth_anomalies(grid, key, time, value).drop("is_anomaly")
    hourly = joins.weather_hourly(weather)
    joined = cut(joins.join_weather_hour(smooth, hourly, time, location=key, ties=()))
    ts = F.col(time)
    dated = joined.withColumns({"hour": F.hour(ts), "weekday": F.weekday(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "is_weekend": calendar.is_weekend(ts)})
    dated = joins.holiday_flags(dated, holidays, time).drop("is_pre_holiday").withColumn("time_category", calendar.time_category(F.col("hour")))
    scaled = shaping.normalize_occupancy(dated, value)
    open_numbers = [value, *joins.WEATHER]
    return fill_forward_back(interpolate_time(scaled, [key], time, open_numbers), [key], time, categorical)
