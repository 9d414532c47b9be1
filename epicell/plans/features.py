"""The feature jobs: batch features per target and the live features of a set of events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicell.constants import M2_WINDOWS_DAYS, WINDOWS_DAYS
from epicell.operators.background import background_rate, background_rate_live
from epicell.operators.features import (
    encode_first_seen,
    join_features_labels,
    ratio_features,
    union_catalogs,
)
from epicell.operators.followups import elapsed_since_last, forward_labels
from epicell.operators.impute import impute_by_prefix
from epicell.operators.nearest import (
    nearest_centroid_attr,
    nearest_line_km,
    nearest_station,
    nearest_vertex_km,
)
from epicell.operators.windows import (
    attach,
    batch_columns,
    context_family,
    elapsed_column,
    live_columns,
    m2_columns,
    m4_family,
    neighborhood_stats,
    rolling_m2_family,
)
from epicell.plans.columns import LIVE_COLUMNS, REFERENCE_COLUMNS
from epicell.session import settle, together


@dataclass
class Geology:
    """The static layers. segments: polyline_segments output; line_types: line_id, slip_type."""

    plate_vertices: DataFrame
    plate_segments: DataFrame
    fault_segments: DataFrame
    line_types: DataFrame
    stations: DataFrame


def fault_and_stress(events: DataFrame, geology: Geology) -> list[DataFrame]:
    """Fault distance, slip code and stress state, one frame each; their searches run side by side."""
    return together(
        lambda: nearest_line_km(events, geology.fault_segments, "dist_to_nearest_fault_km"),
        lambda: nearest_centroid_attr(events, geology.fault_segments, geology.line_types),
        lambda: nearest_station(events, geology.stations),
    )


def join_all(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    for part in parts:
        df = df.join(part, "event_id", "left")
    return df


def compute_features(events: DataFrame, rolling: DataFrame, hist: DataFrame, geology: Geology) -> DataFrame:
    """All live columns per event: event_id plus LIVE_COLUMNS in order.

    One neighbour join feeds both event families, all windows and the elapsed time. The other
    parts end partitioned by event_id, so assembling them needs no further shuffle of theirs.
    """
    families = {"m4": m4_family(), "m2": rolling_m2_family()}
    columns = {"elapsed_since_last_s": elapsed_column("m4")}
    for w in WINDOWS_DAYS:
        columns |= live_columns("m4", w)
    for w in M2_WINDOWS_DAYS:
        columns |= m2_columns("m2", w, live=True)
    base = attach(events, neighborhood_stats(events, rolling, families)).select(
        "event_id", "latitude", "longitude", "event_us", "magnitude", "depth", *[c.alias(n) for n, c in columns.items()]
    )
    place = events.select("event_id", "latitude", "longitude")
    parts = together(
        lambda: nearest_vertex_km(place, geology.plate_vertices),
        lambda: nearest_line_km(place, geology.fault_segments, "dist_to_nearest_fault_km"),
        lambda: nearest_centroid_attr(place, geology.fault_segments, geology.line_types),
        lambda: nearest_station(place, geology.stations),
    )
    full = join_all(ratio_features(background_rate_live(base, hist)), parts)
    return full.select("event_id", *LIVE_COLUMNS)


def batch_features(targets: DataFrame, context: DataFrame, plate_segments: DataFrame) -> DataFrame:
    """One row per target: keys, reference columns, 41 window, 9 context columns, plate distance."""
    # read by every search below, which have no use for the codes
    merged = settle(union_catalogs(targets, context), "merged")
    wanted = merged.where("is_target")
    families = {"m4": m4_family(), "m2": context_family()}
    # read twice below: for the windows and as the first answers of the elapsed search
    stats = settle(neighborhood_stats(wanted, merged, families), "window-stats")
    columns = {}
    for w in WINDOWS_DAYS:
        columns |= batch_columns("m4", w)
    for w in M2_WINDOWS_DAYS:
        columns |= m2_columns("m2", w, live=False)
    coded = encode_first_seen(merged, among=F.col("is_target")).where("is_target")
    reference = [c for c in REFERENCE_COLUMNS if c in coded.columns]
    windows = attach(coded, stats).select(
        "event_id",
        "event_us",
        F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        F.col("latitude").alias("ref_lat"),
        F.col("longitude").alias("ref_lon"),
        *reference,
        *[c.alias(n) for n, c in columns.items()],
    )
    known = stats.where(F.col("m4_last_us").isNotNull())
    elapsed = elapsed_since_last(wanted, merged, known=known)
    plates = nearest_line_km(wanted, plate_segments, "dist_to_plate_boundary_km")
    return windows.join(elapsed, "event_id").join(plates, "event_id", "left")


def add_external(df: DataFrame, geology: Geology) -> DataFrame:
    """Faults, stress stations and background rate on an assembled batch data set."""
    place = df.select("event_id", F.col("ref_lat").alias("latitude"), F.col("ref_lon").alias("longitude"))
    out = join_all(df, fault_and_stress(place, geology))
    at_ref = out.withColumns({"latitude": F.col("ref_lat"), "longitude": F.col("ref_lon")})
    return background_rate(at_ref)


def build_dataset(targets: DataFrame, context: DataFrame, geology: Geology, labelled: DataFrame | None = None) -> DataFrame:
    """The training set: features joined to labels, imputed, with ratios and external features.

    The joined frame is written once: imputation and background rate read it several times.
    """
    labels = forward_labels(targets if labelled is None else labelled)
    joined = settle(join_features_labels(batch_features(targets, context, geology.plate_segments), labels), "dataset")
    skip = ["event_id", "event_us", *["datetime", "ref_lat", "ref_lon", "label_7d", "label_30d", "label_365d"]]
    return add_external(ratio_features(impute_by_prefix(joined, skip)), geology)
