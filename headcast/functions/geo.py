"""Geometry on the sphere and in the plane, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres, as the distances are defined with.
EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def heading_error(heading: Column, bearing: Column) -> Column:
    return F.abs(F.pmod(heading - bearing + 180, F.lit(360.0)) - 180)


def segment_projection(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Fraction along a segment (0 to 1) of the point nearest to (lat, lon), and its distance in metres.

    Degrees become metres on a plane that touches the earth at the mean of the three points.
    """
    ref_lat, ref_lon = (lat + lat1 + lat2) / 3, (lon + lon1 + lon2) / 3
    x = lambda o: F.radians(o - ref_lon) * F.cos(F.radians(ref_lat)) * EARTH_M
    y = lambda a: F.radians(a - ref_lat) * EARTH_M
    dx, dy = x(lon2) - x(lon1), y(lat2) - y(lat1)
    squared = dx * dx + dy * dy
    along = F.when(squared > 0, ((x(lon) - x(lon1)) * dx + (y(lat) - y(lat1)) * dy) / squared).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return t, F.hypot(x(lon) - (x(lon1) + t * dx), y(lat) - (y(lat1) + t * dy))
