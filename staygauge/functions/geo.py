"""Column functions on coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from staygauge import fixed_values as fixed


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres between points given in degrees."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    a = F.least(a, F.lit(1.0))
    return F.lit(2 * fixed.EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere. Straight-line distance there grows with great-circle distance, so a plain 3-d grid
    finds neighbours without special cases at the poles or the date line."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord_of_km(km: float) -> float:
    """Straight-line distance on the unit sphere of two points ``km`` apart along the surface."""
    return 2 * math.sin(min(km / (2 * fixed.EARTH_RADIUS_KM), math.pi / 2))


def chord_of_km_column(km: Column) -> Column:
    return 2 * F.sin(F.least(km / (2 * fixed.EARTH_RADIUS_KM), F.lit(math.pi / 2)))
