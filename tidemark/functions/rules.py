"""Field rules of the record validators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted forms of identifiers, times and flags.
LOCATION_PATTERN = r"^[A-Za-z0-9\-_]+$"
TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd",
]
FLAG_WORDS = ["true", "false", "0", "1"]


def not_true(c: Column) -> Column:
    """Negation that treats unknown as false, so a null never passes a rule."""
    return ~F.coalesce(c, F.lit(False))


def valid_location(c: Column) -> Column:
    return c.cast("string").rlike(LOCATION_PATTERN)


def parse_time(text: Column) -> Column:
    """Instant of the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def valid_time(text: Column) -> Column:
    return parse_time(text).isNotNull()


def valid_flag(c: Column) -> Column:
    return F.lower(c.cast("string")).isin(FLAG_WORDS)


def reasons(rules: dict[str, Column]) -> Column:
    """Array of the names of the broken rules, in rule order; the columns say what is wrong."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def share_rule(c: Column) -> Column:
    return not_true(c.between(0, 1))


def feature_rules() -> dict[str, Column]:
    return {
        "invalid_occupancy_rate": share_rule(F.col("occupancy_rate")),
        "invalid_location_id": not_true(valid_location(F.col("location_id"))),
        "invalid_timestamp": not_true(valid_time(F.col("timestamp"))),
        "invalid_is_holiday": not_true(valid_flag(F.col("is_holiday"))),
        "invalid_day_of_week": not_true(F.col("day_of_week").between(0, 6)),
        "invalid_hour_of_day": not_true(F.col("hour_of_day").between(0, 23)),
    }


def prediction_rules() -> dict[str, Column]:
    return {
        "invalid_predicted_occupancy": share_rule(F.col("predicted_occupancy")),
        "invalid_location_id": not_true(valid_location(F.col("location_id"))),
        "invalid_prediction_timestamp": not_true(valid_time(F.col("prediction_timestamp"))),
        "invalid_predicted_for_timestamp": not_true(valid_time(F.col("predicted_for_timestamp"))),
        "invalid_model_version": not_true(F.trim(F.col("model_version")) != ""),
    }


def expected_rate(available: Column, total: Column) -> Column:
    return F.when(total > 0, 1 - available / total).otherwise(0.0)


RATE_TOLERANCE = 0.01


def raw_rules() -> dict[str, Column]:
    total, free, rate = F.col("total_spots"), F.col("available_spots"), F.col("occupancy_rate")
    known = total.isNotNull() & free.isNotNull() & rate.isNotNull()
    return {
        "invalid_occupancy_rate": share_rule(rate),
        "invalid_location_id": not_true(valid_location(F.col("location_id"))),
        "invalid_timestamp": not_true(valid_time(F.col("timestamp"))),
        "invalid_total_spots": not_true(total > 0),
        "invalid_available_spots": not_true(free >= 0) | F.coalesce(free > total, F.lit(False)),
        "inconsistent_occupancy_calculation": known & (F.abs(expected_rate(free, total) - rate) > RATE_TOLERANCE),
    }


REQUIRED = {
    "feature": ["occupancy_rate", "location_id", "timestamp", "is_holiday", "day_of_week", "hour_of_day"],
    "prediction": ["predicted_occupancy", "location_id", "prediction_timestamp", "predicted_for_timestamp", "model_version"],
    "raw": ["occupancy_rate", "location_id", "timestamp", "total_spots", "available_spots"],
}
RULES = {"feature": feature_rules, "prediction": prediction_rules, "raw": raw_rules}
