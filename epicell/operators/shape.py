"""Small shared helpers: picking one row per key, columns by type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the smallest by `order`.

    An aggregate and not a ranking window: copies collapse before the shuffle, so a key
    that holds a third of all rows does not land in one sort.
    """
    return _pick(df, keys, F.min_by(F.struct(*_rest(df, keys)), F.struct(*order)))


def pick_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the largest by `order`."""
    return _pick(df, keys, F.max_by(F.struct(*_rest(df, keys)), F.struct(*order)))


def _rest(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return rest or [F.lit(1).alias("one")]


def _pick(df: DataFrame, keys: Sequence[str], chosen: Column) -> DataFrame:
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(chosen.alias("picked_row"))
    return picked.select(*[_source(c, keys) for c in df.columns])


def _source(column: str, keys: Sequence[str]) -> Column:
    if column in keys:
        return F.col(f"`{column}`")
    return F.col("picked_row").getField(column).alias(column)


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds and c not in skip]


def double_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float")]
