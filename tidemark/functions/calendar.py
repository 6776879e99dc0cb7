"""Calendar and time-of-day expressions (weekday 0 = Monday)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def flag(cond: Column) -> Column:
    """0/1 with null as 0, like a comparison on missing data."""
    return F.when(cond, 1).otherwise(0).cast("bigint")


def parts(ts: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "weekday": F.weekday(ts),
        "month": F.month(ts),
        "day": F.day(ts),
        "day_of_year": F.dayofyear(ts),
        "iso_week": F.weekofyear(ts),
        "date": F.to_date(ts),
        "day_name": F.date_format(ts, "EEEE"),
        "month_name": F.date_format(ts, "MMMM"),
    }


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def hours(ts: Column) -> Column:
    """Hour of day with minutes as a fraction."""
    return F.hour(ts) + F.minute(ts) / 60


def cycle(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a period."""
    angle = F.lit(2 * math.pi) * x / period
    return F.sin(angle), F.cos(angle)


def cyclical(ts: Column) -> dict[str, Column]:
    out = {}
    for name, x, period in (
        ("hour", F.hour(ts), 24),
        ("weekday", F.weekday(ts), 7),
        ("month", F.month(ts), 12),
        ("halfday", F.hour(ts), 12),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = cycle(x, period)
    return out


def slot_from_eight(ts: Column) -> Column:
    """1-based five-minute slot counted from 08:00, without bounds."""
    return (F.hour(ts) - 8) * 12 + F.floor(F.minute(ts) / 5) + 1


def slot_in_hours(ts: Column) -> Column:
    """0-based slot in [08:00, 20:00), -1 outside."""
    h = F.hour(ts)
    return F.when((h >= 8) & (h < 20), F.floor(((h - 8) * 60 + F.minute(ts)) / 5)).otherwise(-1)


def slot_of_day(ts: Column) -> Column:
    return F.hour(ts) * 12 + F.floor(F.minute(ts) / 5)


def time_category(hour: Column) -> Column:
    return (
        F.when((hour >= 0) & (hour < 6), "night")
        .when((hour >= 6) & (hour < 12), "morning")
        .when((hour >= 12) & (hour < 18), "afternoon")
        .when((hour >= 18) & (hour < 24), "evening")
    )


def period_flags(hour: Column, weekend: Column) -> dict[str, Column]:
    return {
        "morning_peak": flag(hour.between(7, 10)),
        "midday": flag(hour.between(11, 15)),
        "evening_peak": flag(hour.between(16, 19)),
        "night": flag((hour >= 20) | (hour <= 6)),
        "business_hours": flag(hour.between(9, 17) & ~weekend),
    }


def day_flags(weekday: Column) -> dict[str, Column]:
    return {
        "workday": flag(weekday < 5),
        "monday": flag(weekday == 0),
        "friday": flag(weekday == 4),
        "saturday": flag(weekday == 5),
        "sunday": flag(weekday == 6),
    }


def offsets(ts: Column) -> dict[str, Column]:
    return {
        "hours_since_midnight": hours(ts),
        "days_since_month_start": F.day(ts) - 1,
        "days_until_month_end": F.day(F.last_day(ts)) - F.day(ts),
    }


def regulated(hour: Column) -> Column:
    return flag((hour >= 8) & (hour < 20))


def operational(hour: Column) -> Column:
    return hour.between(7, 18)
