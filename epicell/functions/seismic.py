"""Seismology aggregates as Column expressions over the rows of a group."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_EVENTS_FOR_B = 5
MOMENT_FACTOR = 10.0**9.1


def energy_term(mag: Column) -> Column:
    return F.pow(F.lit(10.0), mag * 1.5)


def seismic_energy(mag: Column) -> Column:
    """Sum of 10^(1.5 M)."""
    return F.sum(energy_term(mag))


def seismic_moment(mag: Column) -> Column:
    """Sum of 10^(1.5 M + 9.1)."""
    return F.sum(F.pow(F.lit(10.0), mag * 1.5 + 9.1))


def b_value_from_stats(n: Column, mean: Column, lowest: Column, highest: Column) -> Column:
    """b-value against the smallest magnitude of the window.

    NULL under five events. All magnitudes equal means a zero denominator; that is tested
    on the extremes, because a mean can miss the common value by one rounding step.
    """
    usable = (n >= MIN_EVENTS_FOR_B) & (highest > lowest)
    return F.when(usable, F.lit(math.log10(math.e)) / (mean - lowest))


def b_value_fixed_from_stats(n: Column, mean: Column, highest: Column, mc: float = 2.0) -> Column:
    """b-value against a fixed completeness magnitude; statistics over rows with M >= mc."""
    usable = (n >= MIN_EVENTS_FOR_B) & (highest > mc)
    return F.when(usable, F.lit(1.0) / ((mean - mc) * math.log(10.0)))


def b_value_mle_batch(mag: Column) -> Column:
    return b_value_from_stats(F.count(mag), F.avg(mag), F.min(mag), F.max(mag))


def b_value_mle_fixed(mag: Column, mc: float = 2.0) -> Column:
    above = F.when(mag >= mc, mag)
    return b_value_fixed_from_stats(F.count(above), F.avg(above), F.max(above), mc)
