"""Column builders for distances, local coordinates and positions along a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EARTH_RADIUS_M, METERS_PER_DEGREE


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def extent(lat: Column, lon: Column, radius: Column) -> Column:
    """The northernmost, southernmost, easternmost and westernmost point of a zone."""
    north = radius / METERS_PER_DEGREE
    east = radius / F.greatest(F.lit(1e-6), F.lit(METERS_PER_DEGREE) * F.cos(F.radians(lat)))
    return F.array(*[F.struct((lat + a * north).alias("latitude"), (lon + b * east).alias("longitude")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])


def ring(lat: Column, lon: Column, radius: Column, corners: int = 32) -> Column:
    """A closed polygon around a point, as an array of (longitude, latitude) pairs; the first corner ends it too."""
    def corner(i: Column) -> Column:
        angle = 2 * F.pi() * (i % corners) / corners  # from the east, against the clock
        east, north = radius * F.cos(angle), radius * F.sin(angle)
        return F.array(lon + east / (F.lit(METERS_PER_DEGREE) * F.cos(F.radians(lat))), lat + north / METERS_PER_DEGREE)

    return F.transform(F.sequence(F.lit(0), F.lit(corners)), corner)


def milli(x: Column) -> Column:
    """Thousandths as a whole number, halves upwards; what results are compared by."""
    return F.floor(x * 1000 + 0.5).cast("long")


def plain(x: Column) -> Column:
    """A number as text without exponent or needless zeros: 12, 0.5, 12345678.25."""
    return F.regexp_replace(x.cast("double").cast("string").cast("decimal(38,15)").cast("string"), "\\.?0+$", "")
