"""Great-circle distance and implied speed as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2.0
    half_lon = F.radians(lon2 - lon1) / 2.0
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2.0 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), chord))))


def velocity_kmh(distance_km: Column, elapsed_s: Column, cap: float) -> Column:
    """Speed in km/h, capped. A distance covered in no time is the cap."""
    instant = F.when(distance_km > 0, F.lit(cap)).otherwise(F.lit(0.0))
    return F.when(elapsed_s <= 0, instant).otherwise(F.least(F.lit(cap), distance_km * 3600.0 / elapsed_s))
