"""Geometry on the sphere and in the web-mercator plane, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from epicell.constants import EARTH_KM, MERCATOR_M


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere."""
    cos_lat = F.cos(F.radians(lat))
    return cos_lat * F.cos(F.radians(lon)), cos_lat * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def chord_sq(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Squared straight-line distance of two unit vectors."""
    dx, dy, dz = (p - q for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def chord_to_km(chord: Column) -> Column:
    """Great-circle kilometres from a chord of the unit sphere."""
    half = F.greatest(F.lit(0.0), F.least(F.lit(1.0), chord / 2))
    return F.lit(2 * EARTH_KM) * F.asin(half)


def km_to_chord(km: float) -> float:
    """Chord of the unit sphere that spans `km` kilometres."""
    return 2.0 * math.sin(min(km / (2.0 * EARTH_KM), math.pi / 2))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    x = F.radians(lon) * MERCATOR_M
    y = F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M
    return x, y


def point_segment_dist_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance of a point to a segment; a zero-length segment is a point."""
    dx, dy = bx - ax, by - ay
    len_sq = dx * dx + dy * dy
    along = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, len_sq), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)
