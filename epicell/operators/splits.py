"""Train, validation and test by time or by hash."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicell.constants import HISTORY_YEAR
from epicell.functions.timeparse import year_of_us

# ---- fixed values: last instants of the temporal split, midnight UTC ----
TRAIN_END = "2018-12-31"
VALIDATION_END = "2021-12-31"
TEST_END = "2026-12-31"
# ---- end of fixed values ----


def midnight_us(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


def split_by_year(df: DataFrame, us: str = "event_us", test_year: int = HISTORY_YEAR) -> DataFrame:
    return df.withColumn("split", F.when(year_of_us(F.col(us)) < test_year, "train").otherwise("test"))


def split_temporal(df: DataFrame, us: str = "event_us") -> DataFrame:
    """Bounds are instants at midnight, so most of the last day already is in the next split."""
    t = F.col(us)
    split = (
        F.when(t <= midnight_us(TRAIN_END), "train")
        .when(t <= midnight_us(VALIDATION_END), "validation")
        .when(t <= midnight_us(TEST_END), "test")
    )
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def split_year_ranges(df: DataFrame, us: str = "event_us") -> DataFrame:
    """Up to 2018, 2019-2022, 2023-2025; later rows belong to no split."""
    year = year_of_us(F.col(us))
    split = F.when(year <= 2018, "train").when(year <= 2022, "validation").when(year <= 2025, "test")
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def split_random(df: DataFrame, key: str = "event_id", train_percent: int = 80, seed: int = 42) -> DataFrame:
    """Stable random split: depends on the key alone, not on partitioning, and any engine can repeat it.

    The draw is the first 32 bits of md5("seed:key"), modulo 100; a NULL key is in the test part.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    draw = F.when(F.col(key).isNotNull(), F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100)
    return df.withColumn("split", F.when(draw < train_percent, "train").otherwise("test"))
