"""Forward labels, delayed outcomes and time since the last event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicell.constants import (
    DAY_US,
    HORIZONS_DAYS,
    MIN_MAG_FOLLOWUP,
    MIN_MAG_WINDOW,
    RADIUS_KM,
    SECOND_US,
)
from epicell.functions.timeparse import floor_div
from epicell.operators.neighbors import TimeSpan, near_pairs
from epicell.session import settle

SPOT = ("spot_lat", "spot_lon", "spot_t")
NEAR = ("near_lat", "near_lon", "near_t")


def _distinct_spots(df: DataFrame, time: Column, names: Sequence[str]) -> DataFrame:
    """Distinct (place, time step) of a frame: copies and same-step repeats count once."""
    return df.select(
        F.col("latitude").alias(names[0]), F.col("longitude").alias(names[1]), time.alias(names[2])
    ).distinct()


def _back_to_events(events: DataFrame, time: Column, spots: DataFrame) -> DataFrame:
    on = (
        (F.col("latitude") == F.col(SPOT[0]))
        & (F.col("longitude") == F.col(SPOT[1]))
        & (time == F.col(SPOT[2]))
    )
    return events.join(spots, on, "left").drop(*SPOT)


def _is_followup_size(mag: Column) -> Column:
    # the label job compares in single precision
    return mag.cast("float") >= MIN_MAG_FOLLOWUP


def _day(df_col: str = "event_us") -> Column:
    return floor_div(F.col(df_col), DAY_US)


NEAR_DAYS = 30


def _first_gap(events: DataFrame, catalog: DataFrame, last_day: int, km: float) -> DataFrame:
    """Smallest forward distance in days within [1, last_day] per distinct spot.

    A first pass looks NEAR_DAYS ahead and answers every busy place. A spot it leaves open has no
    follow-up in reach for NEAR_DAYS, so of each later stretch of that length only the first day per
    place can matter, and the second pass runs on that much smaller catalogue.
    """
    # both sides of a join are read to count its blocks, and again for its rows
    spots = settle(_distinct_spots(events, _day(), SPOT), "spots")
    later = settle(_distinct_spots(catalog.where(_is_followup_size(F.col("magnitude"))), _day(), NEAR), "instants")

    def gaps(open_spots: DataFrame, days: DataFrame, first: int, last: int) -> DataFrame:
        span = TimeSpan(SPOT[2], NEAR[2], first, last)
        pairs = near_pairs(open_spots, days, SPOT[:2], NEAR[:2], km, span)
        return pairs.groupBy(*SPOT).agg(F.min(F.col(NEAR[2]) - F.col(SPOT[2])).alias("min_days"))

    if last_day <= NEAR_DAYS:
        return gaps(spots, later, 1, last_day)
    soon = settle(gaps(spots, later, 1, NEAR_DAYS), "followups")
    stretch = floor_div(F.col(NEAR[2]), NEAR_DAYS)
    thinned = later.groupBy(*NEAR[:2], stretch.alias("stretch")).agg(F.min(NEAR[2]).alias(NEAR[2])).drop("stretch")
    thinned = settle(thinned, "thinned")
    open_spots = settle(spots.join(soon, list(SPOT), "left_anti"), "open")
    return soon.unionByName(gaps(open_spots, thinned, NEAR_DAYS + 1, last_day))


def forward_label_join(
    targets: DataFrame, catalog: DataFrame, max_days: int = max(HORIZONS_DAYS), km: float = RADIUS_KM
) -> DataFrame:
    """(event_id, min_days): days to the first M>=5 follow-up, on day granularity.

    A follow-up on the same day has distance 0 and does not count, which also rules out the
    event itself and its copies.
    """
    gaps = _first_gap(targets, catalog, max_days, km)
    return _back_to_events(targets, _day(), gaps).where(F.col("min_days").isNotNull()).select("event_id", "min_days")


def forward_labels(
    events: DataFrame,
    catalog: DataFrame | None = None,
    horizons: Sequence[int] = HORIZONS_DAYS,
    km: float = RADIUS_KM,
) -> DataFrame:
    """Every event with its labels: 1 when a follow-up lies within the horizon.

    The smallest distance is found once, and all horizons are read from it.
    """
    catalog = events if catalog is None else catalog
    gaps = _first_gap(events, catalog, max(horizons), km)
    labelled = _back_to_events(events, _day(), gaps)
    return labelled.select(
        "event_id",
        "event_us",
        F.col("latitude").alias("ref_lat"),
        F.col("longitude").alias("ref_lon"),
        F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd").alias("ref_date"),
        *[F.coalesce((F.col("min_days") <= h).cast("int"), F.lit(0)).alias(f"label_{h}d") for h in horizons],
    )


def followup_exists(events: DataFrame, catalog: DataFrame, days: int, km: float = RADIUS_KM) -> DataFrame:
    """(event_id, has_followup): an M>=5 event within [t + 1 s, t + days], by whole seconds."""
    second = floor_div(F.col("event_us"), SECOND_US)
    spots = _distinct_spots(events, second, SPOT)
    # the bounds are whole seconds, the catalogue is not: compare its instants in microseconds
    big = catalog.where(F.col("magnitude") >= MIN_MAG_FOLLOWUP)
    later = _distinct_spots(big, F.col("event_us"), NEAR)
    spots = spots.withColumn("spot_us", F.col(SPOT[2]) * SECOND_US)
    span = TimeSpan("spot_us", NEAR[2], SECOND_US, days * DAY_US)
    hits = near_pairs(spots, later, SPOT[:2], NEAR[:2], km, span).select(*SPOT).distinct()
    hits = hits.withColumn("hit", F.lit(True))
    return _back_to_events(events, second, hits).select(
        "event_id", F.coalesce(F.col("hit"), F.lit(False)).alias("has_followup")
    )


def elapsed_since_last(
    targets: DataFrame,
    catalog: DataFrame,
    lookback_days: int | None = None,
    min_mag: float = MIN_MAG_WINDOW,
    km: float = RADIUS_KM,
    passes: Sequence[int] = (90, 1080),
    known: DataFrame | None = None,
) -> DataFrame:
    """(event_id, elapsed_since_last_s): seconds since the latest earlier event in reach.

    Without a lookback limit the search widens: most targets are answered by the first
    pass, whose bucket is `passes[0]` days; the rest look further back. A target that is not
    answered has nothing in reach in that last stretch, so for the wider passes the latest
    instant per place and bucket is all that can matter, and the catalogue shrinks to it.
    `known` may bring the answers of the first pass (at_lat, at_lon, at_us, m4_last_us), as the
    window statistics have them.
    """
    strong = catalog.where(F.col("magnitude") >= min_mag)
    instants = settle(_distinct_spots(strong, F.col("event_us"), NEAR), "instants")
    spots = settle(_distinct_spots(targets, F.col("event_us"), SPOT), "spots")

    def latest(open_spots: DataFrame, history: DataFrame, days: int | None) -> DataFrame:
        span = None if days is None else TimeSpan(SPOT[2], NEAR[2], -days * DAY_US, 0, hi_open=True)
        pairs = near_pairs(open_spots, history, SPOT[:2], NEAR[:2], km, span)
        earlier = pairs if days is not None else pairs.where(F.col(NEAR[2]) < F.col(SPOT[2]))
        return earlier.groupBy(*SPOT).agg(F.max(NEAR[2]).alias("last_us"))

    if lookback_days is not None:
        answered = latest(spots, instants, lookback_days)
    else:
        first = passes[0]
        bucket = floor_div(F.col(NEAR[2]), first * DAY_US)
        thinned = instants.groupBy(*NEAR[:2], bucket.alias("thin_bucket")).agg(F.max(NEAR[2]).alias(NEAR[2]))
        thinned = settle(thinned.drop("thin_bucket"), "thinned")
        if known is None:
            answered = latest(spots, instants, first)
        else:
            names = zip(("at_lat", "at_lon", "at_us", "m4_last_us"), (*SPOT, "last_us"))
            answered = known.select(*[F.col(a).alias(b) for a, b in names])
        for days in [*passes[1:], None]:
            # each pass reads the answers twice (what is open, what is known): write them once
            answered = settle(answered, "elapsed")
            open_spots = settle(spots.join(answered, list(SPOT), "left_anti"), "open")
            answered = answered.unionByName(latest(open_spots, thinned, days))

    elapsed = (F.col("event_us") - F.col("last_us")) / F.lit(float(SECOND_US))
    return _back_to_events(targets, F.col("event_us"), answered).select(
        "event_id", elapsed.alias("elapsed_since_last_s")
    )
