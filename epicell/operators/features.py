"""Derived feature columns, categorical codes in order of appearance, catalogue union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epicell.constants import DAYS_PER_YEAR, EPS
from epicell.operators.cleaning import clip
from epicell.operators.order_stats import running_below
from epicell.operators.shape import pick_first, pick_last
from epicell.session import settle


def safe_div(a: Column, b: Column) -> Column:
    return a / (b + EPS)


def ratio_features(df: DataFrame) -> DataFrame:
    """accel_count, accel_energy, mag_excess."""
    week_of = lambda c: F.col(c) / 90.0 * 7.0
    return df.withColumns(
        {
            "accel_count": clip(safe_div(F.col("count_7d"), week_of("count_90d")), 0.0, 500.0),
            "accel_energy": clip(safe_div(F.col("energy_7d"), week_of("energy_90d")), 0.0, 500.0),
            "mag_excess": F.col("magnitude") - F.coalesce(F.col("mag_mean_90d"), F.col("magnitude")),
        }
    )


def thirty_day_features(df: DataFrame) -> DataFrame:
    """The nine columns of the 30-day model; the last one only with a background rate."""
    c = F.col
    per_week = lambda name: c(name) / 30.0 * 7.0
    b90 = F.coalesce(c("b_value_90d"), F.lit(1.0))
    b30 = F.coalesce(c("b_value_30d"), c("b_value_90d"), F.lit(1.0))
    or_depth = lambda name: F.coalesce(c(name), c("depth"))
    or_mag = lambda name: F.coalesce(c(name), c("magnitude"))
    out = {
        "omori_proxy": clip(safe_div(c("count_1d"), c("count_7d") / 7.0), 0.0, 100.0),
        "rate_7d_vs_30d": clip(safe_div(c("rate_7d"), c("rate_30d")), 0.0, 200.0),
        "energy_7d_vs_30d": clip(safe_div(c("energy_7d"), per_week("energy_30d")), 0.0, 200.0),
        "moment_7d_vs_30d": clip(safe_div(c("moment_7d"), per_week("moment_30d")), 0.0, 200.0),
        "b_trend_30d_90d": clip(b30 - b90, -1.0, 1.0),
        "depth_migration": clip(or_depth("depth_mean_7d") - or_depth("depth_mean_30d"), -50.0, 50.0),
        "bath_proxy": clip(c("magnitude") - (or_mag("mag_max_30d") - 1.2), -3.0, 3.0),
        "mag_accel_7d_30d": clip(or_mag("mag_mean_7d") - or_mag("mag_mean_30d"), -2.0, 2.0),
    }
    if "background_rate_yr" in df.columns:
        expected = c("background_rate_yr") * (30.0 / DAYS_PER_YEAR)
        out["count_30d_norm"] = clip(safe_div(c("count_30d"), expected), 0.0, 500.0)
    return df.withColumns(out)


def encode_first_seen(
    df: DataFrame, col: str = "mag_type", out: str = "mag_type_enc", among: Column | None = None
) -> DataFrame:
    """Code = rank of the value's first appearance in time (ties by event_id); NULL is "unknown".

    One row per distinct value is ranked, by totals over ranges of time, so a free text with very many
    values is no single task either. The code table is written before the join, so Spark knows its
    true size and need not shuffle the events by a value that most of them share. Values that only
    occur outside `among` have no code.
    """
    value = F.coalesce(F.col(col), F.lit("unknown"))
    seen = df if among is None else df.where(among)
    firsts = seen.groupBy(value.alias("seen_value")).agg(F.min(F.struct("event_us", "event_id")).alias("first_at"))
    firsts = firsts.withColumn("instant", F.coalesce(F.col("first_at.event_us").cast("double"), F.lit(-1e18)))
    earlier = running_below(firsts.groupBy("instant").agg(F.count(F.lit(1)).alias("n")), [], "instant", ["n"])
    within = F.row_number().over(Window.partitionBy("instant").orderBy("first_at"))
    ranked = firsts.withColumn("within", within).join(earlier.select("instant", "n_below"), "instant")
    codes = settle(ranked.select("seen_value", (F.col("n_below") + F.col("within") - 1).cast("int").alias(out)), "codes")
    return df.withColumn("seen_value", value).join(codes, "seen_value", "left").drop("seen_value")


def union_catalogs(targets: DataFrame, context: DataFrame) -> DataFrame:
    """Target and context rows in one frame, one row per (time, place), the target row kept.

    A row in both keeps is_m2_ctx = false.
    """
    both = targets.withColumns({"is_target": F.lit(True), "is_m2_ctx": F.lit(False)}).unionByName(
        context.withColumns({"is_target": F.lit(False), "is_m2_ctx": F.lit(True)}), allowMissingColumns=True
    )
    return dedup_keep_first(both, ["event_us", "latitude", "longitude"], [~F.col("is_target"), F.col("event_id")])


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return pick_first(df, keys, order)


def dedup_keep_last(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return pick_last(df, [key], order)


def join_features_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on (lat, lon rounded to 4 decimals, day), first row per key on both sides.

    `features`: event_id, event_us, ref_lat, ref_lon, ...; `labels`: event_id, event_us, ref_lat,
    ref_lon, label_*. First means earliest, then smallest event_id.
    """
    keys = {
        "key_lat": F.round("ref_lat", 4),
        "key_lon": F.round("ref_lon", 4),
        "key_day": F.to_date(F.timestamp_micros("event_us")),
    }
    order = [F.col("event_us"), F.col("event_id")]
    left = pick_first(features.withColumns(keys), list(keys), order)
    right = pick_first(labels.withColumns(keys), list(keys), order)
    label_cols = [c for c in labels.columns if c.startswith("label_")]
    return left.join(right.select(*keys, *label_cols), list(keys)).drop(*keys)
