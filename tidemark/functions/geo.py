"""Great-circle distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of `radius`."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((a2 - a1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
