"""Latitude-band grid on the sphere: the equi-join keys of the distance joins.

Bands are `deg` degrees high. Each band is cut into the largest number of equal cells
that are still at least `deg` wide (in arc) at the band's edge nearest to a pole, so a
disc meets few cells everywhere, poles included. Keys are plain integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicell.constants import EARTH_KM
from epicell.functions.geo import haversine_km, unit_xyz

BAND_STRIDE = 100_000
PAD_DEG = 1e-6
PAD_KM = 1e-6


def _number(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def band_of(lat: Column, deg: float | Column) -> Column:
    last = F.ceil(F.lit(180.0) / _number(deg)) - 1
    return F.greatest(F.lit(0), F.least(last, F.floor((lat + 90.0) / deg))).cast("bigint")


def cells_in_band(band: Column, deg: float | Column) -> Column:
    edge = F.greatest(F.abs(band * deg - 90.0), F.abs((band + 1) * deg - 90.0))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * 360.0 / deg)).cast("bigint")


def home_cell(lat: Column, lon: Column, deg: float | Column) -> Column:
    """The one cell a point lies in."""
    band = band_of(lat, deg)
    n = cells_in_band(band, deg)
    return band * BAND_STRIDE + F.pmod(F.floor((lon + 180.0) * n / 360.0), n)


def explode_cover(
    df: DataFrame, lat: str, lon: str, km: float | Column, deg: float | Column, out: str = "cell"
) -> DataFrame:
    """Repeat each row for every cell that a disc of `km` around its point can meet.

    Two plain explodes (bands, then cells of a band) keep the arithmetic in generated code.
    """
    return _covered(df, lat, lon, km, deg, out).drop("cover_reach", "cover_band", "cover_n", "cover_index")


def explode_cover_marked(df: DataFrame, lat: str, lon: str, km: float, deg: float) -> DataFrame:
    """Like `explode_cover`, with `whole` = the disc surely holds every point of the cell.

    Cells that the disc surely misses are dropped. What depends on the band alone is computed
    before the second explode, and each test is one dot product with the cell's centre.
    """
    band = F.col("cover_band")
    mid = F.radians((band + 0.5) * deg - 90.0)
    reach = cell_reach_km(band * BAND_STRIDE, deg)
    inner = km - PAD_KM - reach
    at = dict(zip(("cover_x", "cover_y", "cover_z"), unit_xyz(F.col(lat), F.col(lon))))
    per_band = {
        "cover_sin": F.sin(mid),
        "cover_cos": F.cos(mid),
        "cover_in": F.when(inner >= 0, F.cos(inner / EARTH_KM)).otherwise(F.lit(2.0)),
        "cover_out": F.cos(F.least(F.lit(math.pi), (reach + (km + PAD_KM)) / EARTH_KM)),
    }
    mid_lon = (F.col("cover_index") + 0.5) * (2 * math.pi) / F.col("cover_n") - math.pi
    dot = (
        F.col("cover_x") * F.col("cover_cos") * F.cos(mid_lon)
        + F.col("cover_y") * F.col("cover_cos") * F.sin(mid_lon)
        + F.col("cover_z") * F.col("cover_sin")
    )
    covered = _covered(df.withColumns(at), lat, lon, km, deg, "cell", per_band)
    return (
        covered.where(dot >= F.col("cover_out"))
        .withColumn("whole", dot >= F.col("cover_in"))
        .drop("cover_reach", "cover_band", "cover_n", "cover_index", *at, *per_band)
    )


def _covered(
    df: DataFrame,
    lat: str,
    lon: str,
    km: float | Column,
    deg: float | Column,
    out: str,
    per_band: dict[str, Column] | None = None,
) -> DataFrame:
    at_lat, at_lon = F.col(lat), F.col(lon)
    reach = _number(km) / EARTH_KM
    reach_deg = F.degrees(reach) + PAD_DEG
    # also catches a disc wider than a hemisphere, where the sine would shrink again
    touches_pole = F.abs(at_lat) + reach_deg >= 90.0
    ratio = F.least(F.lit(1.0), F.try_divide(F.sin(reach), F.cos(F.radians(at_lat))))
    lon_reach = F.when(touches_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) + PAD_DEG)
    bands = F.sequence(band_of(at_lat - reach_deg, deg), band_of(at_lat + reach_deg, deg))

    banded = (
        df.withColumn("cover_reach", lon_reach)
        .withColumn("cover_band", F.explode(bands))
        .withColumn("cover_n", cells_in_band(F.col("cover_band"), deg))
        .withColumns(per_band or {})
    )
    n = F.col("cover_n")
    first = F.floor((at_lon - F.col("cover_reach") + 180.0) * n / 360.0)
    last = F.floor((at_lon + F.col("cover_reach") + 180.0) * n / 360.0)
    # a span as wide as the band takes each of its cells once
    last_once = F.least(last, first + n - 1)
    cell = F.col("cover_band") * BAND_STRIDE + F.pmod(F.col("cover_index"), n)
    return banded.withColumn("cover_index", F.explode(F.sequence(first, last_once))).withColumn(out, cell)


def cell_center(cell: Column, deg: float | Column) -> tuple[Column, Column]:
    band = F.floor(cell / BAND_STRIDE)
    index = F.pmod(cell, F.lit(BAND_STRIDE))
    n = cells_in_band(band, deg)
    lat = F.least(F.lit(90.0), (band + 0.5) * deg - 90.0)
    return lat, (index + 0.5) * 360.0 / n - 180.0


def cell_reach_km(cell: Column, deg: float | Column) -> Column:
    """Distance from the cell centre that no point of the cell exceeds.

    Along the meridian by at most half the height, then along a parallel by at most half
    the width of the widest parallel of the band.
    """
    band = F.floor(cell / BAND_STRIDE)
    south, north = band * deg - 90.0, (band + 1) * deg - 90.0
    widest = F.when((south < 0) & (north > 0), F.lit(0.0)).otherwise(F.least(F.abs(south), F.abs(north)))
    across = haversine_km(widest, F.lit(0.0), widest, F.lit(180.0) / cells_in_band(band, deg))
    return across + F.radians(_number(deg) / 2) * EARTH_KM + F.lit(PAD_KM)
