"""Weather expressions: bands, comfort and impact factors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.calendar import flag
from tidemark.functions.constants import COMFORT, SMOOTH_COMFORT


def humidity_bands(humidity: Column, table_max: Column) -> dict[str, Column]:
    """Square and bands; a table whose maximum exceeds 1 holds percentages."""
    share = F.when(table_max > 1, humidity / 100).otherwise(humidity)
    return {
        "humidity_squared": humidity * humidity,
        "humidity_low": flag(share < 0.3),
        "humidity_medium": flag((share >= 0.3) & (share < 0.7)),
        "humidity_high": flag(share >= 0.7),
    }


def rain_bands(rain: Column) -> dict[str, Column]:
    return {
        "no_rain": flag(rain == 0),
        "light_rain": flag((rain > 0) & (rain < 2.5)),
        "moderate_rain": flag((rain >= 2.5) & (rain < 10)),
        "heavy_rain": flag(rain >= 10),
        "log_precipitation": F.log1p(rain),
        "precipitation_squared": rain * rain,
    }


def temperature_bands(temp: Column, humidity: Column | None = None) -> dict[str, Column]:
    out = {
        "temp_cold": flag(temp < 10),
        "temp_mild": flag((temp >= 10) & (temp < 20)),
        "temp_warm": flag((temp >= 20) & (temp < 30)),
        "temp_hot": flag(temp >= 30),
    }
    if humidity is not None:
        out["comfort_index"] = temp + F.lit(0.1) * humidity
    return out


def comfort(temp: Column, month: Column, rule: dict = COMFORT) -> Column:
    """Gaussian comfort around an optimum that moves with the season; 1 at the optimum."""
    shift = (
        F.when((month == 12) | (month <= 2), rule["winter"]).when((month >= 6) & (month <= 8), rule["summer"]).otherwise(0.0)
    )
    gap = temp - (F.lit(rule["optimal"]) + shift)
    level = F.exp(-(gap * gap) / (2 * rule["width"] ** 2))
    if "weight" in rule:
        return 1 - F.lit(rule["weight"]) * (1 - level)
    return level


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def rain_damping(rain: Column) -> Column:
    return F.when(rain > 0, 1 - F.lit(0.3) * F.tanh(rain / 10)).otherwise(1.0)


def factor(temp: Column, humidity: Column, wind: Column, rain: Column, month: Column, rule: dict = COMFORT) -> Column:
    """Comfort x rain x wind x humidity."""
    wind_part = _clip(1 - wind / 50, 0.7, 1.0)
    humid_part = 1 - F.lit(0.2) * _clip((humidity - 70) / 30, 0.0, 1.0)
    return comfort(temp, month, rule) * rain_damping(rain) * wind_part * humid_part


def impact(temp: Column, wind: Column, rain: Column, month: Column) -> Column:
    """The second published variant: linear rain and wind damping, no humidity."""
    rain_part = 1.0 - F.lit(0.2) * _clip(rain, 0.0, 1.0)
    wind_part = 1.0 - F.lit(0.1) * _clip(wind / 20, 0.0, 1.0)
    return comfort(temp, month) * rain_part * wind_part


def smooth_factor(temp: Column, humidity: Column, wind: Column, rain: Column, month: Column) -> Column:
    return factor(temp, humidity, wind, rain, month, SMOOTH_COMFORT)


def unweighted_factor(temp: Column, wind: Column, rain: Column, month: Column) -> Column:
    """Weather term of the weighted demand model: no humidity part."""
    return comfort(temp, month, SMOOTH_COMFORT) * rain_damping(rain) * _clip(1 - wind / 50, 0.7, 1.0)
