"""Registered queries and their independent SQL, area by area."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epicell.fixtures import Tables
from epicell.operators.shape import double_columns
from epicell.session import tune

AREAS = ("geo", "scans", "cleaning", "joins", "aggregates", "ranking", "quality", "training", "streams")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# the same without the rounding that only the comparison needs
PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DECIMALS = 6
LOG_SCALED = ("energy", "moment")


def settled_doubles(df: DataFrame) -> DataFrame:
    """Round what summation order may change; sums of powers are compared by magnitude."""
    out = {}
    for name in double_columns(df):
        value = F.col(f"`{name}`").cast("double")
        if name.startswith(LOG_SCALED):
            value = F.log10(value + 1.0)
        out[name] = F.round(value, DECIMALS) + 0.0
    return df.withColumns(out) if out else df


def r(expr: str) -> str:
    """The SQL side of `settled_doubles`."""
    return f"(round(CAST({expr} AS DOUBLE), {DECIMALS}) + CAST(0 AS DOUBLE))"


def rlog(expr: str) -> str:
    return r(f"log10(({expr}) + 1)")


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def check(name: str, oracle: str | None = None):
    """Register a query under its operator name, with its SQL when there is one."""

    def keep(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def plain(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(tune(spark), folder))

        def query(spark: SparkSession, folder: str) -> DataFrame:
            return settled_doubles(plain(spark, folder))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        PLAIN[name] = plain
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"checks.{area}")
