"""Column functions on positions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088


def snap(value: Column, grid: float) -> Column:
    """Centre of the grid cell; the quotient is rounded to 9 places first, as 0.1 is inexact."""
    return F.floor(F.round(value / grid, 9)).cast("double") * grid + grid / 2


def floor_cell(value: Column, grid: float) -> Column:
    """Centre of the grid cell by plain floor."""
    return F.floor(value / grid).cast("double") * grid + grid / 2


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is (least() would take the 1 instead)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, 111.32 km a degree."""
    return 111.32 * F.hypot(lat2 - lat1, (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)))


def cell_area_km2(lat: Column, grid: float) -> Column:
    """Spherical area of the cell centred at lat."""
    band = F.sin(F.radians(lat + grid / 2)) - F.sin(F.radians(lat - grid / 2))
    return EARTH_KM**2 * F.radians(F.lit(grid)) * band


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def cell_id(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f_%.4f", lat, lon)
