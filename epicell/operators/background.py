"""Counting reference events around a place, and the background rate built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicell.constants import (
    DAY_US,
    DAYS_PER_YEAR,
    EPS,
    HISTORY_YEAR,
    MIN_MAG_HISTORY,
    RADIUS_KM,
)
from epicell.functions.geo import chord_sq, km_to_chord, unit_xyz
from epicell.functions.timeparse import floor_div, year_of_us
from epicell.operators.cells import explode_cover_marked, home_cell
from epicell.operators.neighbors import cut_hot_blocks

FINE_DEG = 0.5


def radius_count(
    events: DataFrame, reference: DataFrame, km: float = RADIUS_KM, name: str = "n_near", deg: float = FINE_DEG
) -> DataFrame:
    """(event_id, n_near): reference rows within `km`; zero is kept, a row in both counts itself.

    Places are collapsed on both sides. A fine cell wholly inside the disc adds its
    pre-summed count, so only cells on the rim are compared place by place and a dense
    region never turns into all its pairs.
    """
    places = events.select(F.col("latitude").alias("at_lat"), F.col("longitude").alias("at_lon")).distinct()
    counted = (
        reference.groupBy(F.col("latitude").alias("ref_lat"), F.col("longitude").alias("ref_lon"))
        .agg(F.count(F.lit(1)).alias("n_here"))
        .withColumn("cell", home_cell(F.col("ref_lat"), F.col("ref_lon"), deg))
    )

    per_cell = counted.groupBy("cell").agg(F.sum("n_here").alias("n_here"))

    ref_xyz = dict(zip(("rx", "ry", "rz"), unit_xyz(F.col("ref_lat"), F.col("ref_lon"))))
    at_xyz = dict(zip(("ax", "ay", "az"), unit_xyz(F.col("at_lat"), F.col("at_lon"))))
    no_place = {c: F.lit(None).cast("double") for c in ref_xyz}
    right = (
        counted.withColumns(ref_xyz)
        .withColumn("whole", F.lit(False))
        .select("cell", "whole", "n_here", *ref_xyz)
        .unionByName(per_cell.withColumns(no_place).withColumn("whole", F.lit(True)))
    )
    left = explode_cover_marked(places.withColumns(at_xyz), "at_lat", "at_lon", km, deg)
    gap = chord_sq(tuple(F.col(c) for c in at_xyz), tuple(F.col(c) for c in ref_xyz))
    # a dense cell on the rim of many discs is cut on both sides like any hot block
    left, right, keys = cut_hot_blocks(left, right, ["cell", "whole"])
    near = left.join(right, keys).where(F.col("whole") | (gap <= km_to_chord(km) ** 2))
    totals = near.groupBy("at_lat", "at_lon").agg(F.sum("n_here").alias(name))
    on = (F.col("latitude") == F.col("at_lat")) & (F.col("longitude") == F.col("at_lon"))
    return events.join(totals, on, "left").select("event_id", F.coalesce(F.col(name), F.lit(0)).alias(name))


def history(catalog: DataFrame) -> DataFrame:
    """Rows that define the background: before the first test year, M >= 3."""
    return catalog.where((year_of_us(F.col("event_us")) < HISTORY_YEAR) & (F.col("magnitude") >= MIN_MAG_HISTORY))


def _whole_days_in_years(df: DataFrame) -> Column:
    days = floor_div(F.max("event_us") - F.min("event_us"), DAY_US)
    return (days / F.lit(DAYS_PER_YEAR)).alias("span_years")


def _rates(events: DataFrame, counts: DataFrame, span_years: Column, count_30d: str) -> DataFrame:
    rate = F.col("n_near") / span_years
    expected = F.col("background_rate_yr") * (30.0 / DAYS_PER_YEAR) + EPS
    normalized = F.greatest(F.lit(0.0), F.least(F.lit(200.0), F.col(count_30d) / expected))
    return (
        events.join(counts, "event_id")
        .withColumn("background_rate_yr", rate)
        .withColumn("normalized_rate_30d", F.when(F.col(count_30d).isNotNull(), normalized))
        .drop("n_near")
    )


def background_rate(df: DataFrame, count_30d: str = "count_30d") -> DataFrame:
    """Adds background_rate_yr and normalized_rate_30d. The span is taken from all early rows,
    the counts from the early M>=3 rows."""
    early = df.where(year_of_us(F.col("event_us")) < HISTORY_YEAR)
    span = early.agg(_whole_days_in_years(early)).scalar()
    return _rates(df, radius_count(df, history(df)), span, count_30d)


def background_rate_live(events: DataFrame, hist: DataFrame, count_30d: str = "count_30d") -> DataFrame:
    """Same columns; the span comes from the M>=3 rows and is at least one year."""
    kept = history(hist)
    years = kept.agg(_whole_days_in_years(kept))
    floored = years.select(F.greatest(F.lit(1.0), F.coalesce(F.col("span_years"), F.lit(1.0))).alias("span_years"))
    return _rates(events, radius_count(events, kept), floored.scalar(), count_30d)
