"""Running totals in value order and exact percentiles, without one task seeing all values.

`value_key` is an order-preserving integer of a double, for counting by ranges of values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epicell.operators.rank_select import exact_quantiles
from epicell.session import settle

# an octave of values has 2^40 keys; ranges are 2^-8, 2^-20 and 2^-30 of it
KEY_SCALE = float(2**40)
RANGE_BITS = (32, 20, 10)
LEAST_EXPONENT = 1100.0


def value_key(value: Column) -> Column:
    """Monotone integer key of a double: its binary exponent, then its leading binary places.

    Every octave is resolved alike, however small or large its values are. The logarithm may be off at
    a power of two; exponent and rest then lie on the same straight line, so the order holds.
    """
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    # in two steps: 2^-exponent alone may be beyond the range of a double
    half = F.floor(exponent / 2)
    rest = size * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - exponent)
    key = F.floor((exponent + LEAST_EXPONENT + rest - 1.0) * KEY_SCALE)
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value < 0, -key).otherwise(key)


def running_below(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Adds `{s}_below` = total of `s` over strictly smaller values of the group.

    `df` has one row per (by, value) with a non-NULL value. Rows are dealt by range of (by, value) and written;
    totals are accumulated within a range, and over the ranges of a group before it. So no task has more than one
    range, however many values a group has.
    """
    by = list(by)
    order = [*[F.col(f"`{c}`") for c in by], F.col(f"`{value}`")]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits number the range that a row was dealt to
    ranged = dealt.withColumn("range_no", F.shiftright(F.monotonically_increasing_id(), 33))
    placed = settle(ranged, "ranges")
    within = Window.partitionBy("range_no", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by or [F.lit(0)]).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range of a group
    totals = placed.groupBy("range_no", *by).agg(*[F.sum(s).alias(s) for s in sums])
    before = totals.select("range_no", *by, *[F.coalesce(F.sum(s).over(ahead), F.lit(0)).alias(f"{s}_ahead") for s in sums])
    own = placed.withColumns({f"{s}_own": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums})
    keys = ["range_no", *by]
    renamed = before.withColumnsRenamed({k: f"{k}_before" for k in keys})
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{k}_before`")) for k in keys])
    joined = own.join(renamed, same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"{s}_own") + F.col(f"{s}_ahead")).alias(f"{s}_below") for s in sums])


def exact_percentiles(df: DataFrame, probs: dict[str, float]) -> DataFrame:
    """(col, percentile): linear-interpolated exact percentile per column; columns without a value are absent."""
    return df.sparkSession.createDataFrame(list(percentile_values(df, probs).items()), "col string, percentile double")


def percentile_values(df: DataFrame, probs: dict[str, float]) -> dict[str, float]:
    """The percentiles as a dict, found by histogram refinement."""
    return exact_quantiles(df, probs)
