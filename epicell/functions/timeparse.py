"""Tolerant time parsing and integer time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# starts like a date: the cast alone would also take a bare time of day
DATE_FIRST = r"^[0-9]{4}-[0-9]{1,2}"
CATALOG_FORMAT = "MM/dd/yyyy HH:mm:ss"


def parse_event_time(text: Column, when_missing: Column | None = None) -> Column:
    """ISO text to timestamp: Z and naive are UTC, missing takes `when_missing`, bad is NULL."""
    trimmed = F.trim(text)
    # the cast reads all ISO shapes without a formatter and without exceptions for bad text
    parsed = F.when(trimmed.rlike(DATE_FIRST), trimmed.try_cast("timestamp"))
    if when_missing is None:
        return parsed
    return F.when(text.isNull(), when_missing).otherwise(parsed)


def catalog_time(date: Column, time: Column) -> Column:
    """Event time from the two text columns of a catalogue file; unparsable is NULL."""
    joined = F.concat_ws(" ", F.trim(date), F.trim(time))
    complete = date.isNotNull() & time.isNotNull()
    return F.when(complete, F.try_to_timestamp(joined, F.lit(CATALOG_FORMAT)))


def floor_div(value: Column, width: int) -> Column:
    """Exact integer floor division, also for negative values."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def year_of_us(us: Column) -> Column:
    return F.year(F.timestamp_micros(us))
