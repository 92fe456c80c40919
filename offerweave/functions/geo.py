"""Distances and cells on the map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
CELLS = 500


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on a sphere."""
    r = F.radians
    a = F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """A cell of about 200 m."""
    return F.floor(lat * CELLS), F.floor(lon * CELLS)


def spot(lat: Column, lon: Column) -> Column:
    """Places of one spot share this text."""
    return F.format_string("%.6f,%.6f", lat, lon)


def has_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce((lat != 0) & (lon != 0), F.lit(False))
