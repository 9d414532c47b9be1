"""Catalogue and station files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epicell.functions.timeparse import catalog_time, parse_event_time
from epicell.operators.nearest import usable_stations

# ---- fixed values: column names of the published files ----
CATALOG_RENAMES = {
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Depth": "depth",
    "Magnitude": "magnitude",
    "Magnitude Type": "mag_type",
    "Azimuthal Gap": "gap",
    "Horizontal Distance": "dmin",
    "Root Mean Square": "rms",
    "Horizontal Error": "h_error",
    "depthError": "depth_error",
    "Magnitude Error": "mag_error",
}
FEED_RENAMES = {
    "time": "Date",
    "latitude": "Latitude",
    "longitude": "Longitude",
    "depth": "Depth",
    "mag": "Magnitude",
    "magType": "Magnitude Type",
    "type": "Type",
    "id": "ID",
    "status": "Status",
    "locationSource": "Location Source",
    "magSource": "Magnitude Source",
    "horizontalError": "Horizontal Error",
    "depError": "Depth Error",
    "magError": "Magnitude Error",
    "magNst": "Magnitude Seismic Stations",
    "nst": "Depth Seismic Stations",
    "gap": "Azimuthal Gap",
    "dmin": "Horizontal Distance",
    "rms": "Root Mean Square",
    "net": "Source",
}
# ---- end of fixed values ----

TEXT_COLUMNS = ("mag_type",)


def number(text: Column) -> Column:
    """Text to double; bad text and NaN become NULL."""
    return F.nanvl(F.trim(text).try_cast("double"), F.lit(None).cast("double"))


def read_header_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text under their stripped header names; compressed files are read as they are."""
    raw = spark.read.csv(path, header=True, encoding=encoding, mode="PERMISSIVE")
    return raw.toDF(*[c.strip() for c in raw.columns])


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue file with Date and Time columns; rows without time, place or magnitude are dropped."""
    raw = read_header_csv(spark, path)
    timed = raw.withColumn("event_time", catalog_time(F.col("Date"), F.col("Time")))
    named = timed.withColumnsRenamed({k: v for k, v in CATALOG_RENAMES.items() if k in raw.columns})
    numbers = [v for k, v in CATALOG_RENAMES.items() if k in raw.columns and v not in TEXT_COLUMNS]
    typed = named.withColumns({c: number(F.col(c)) for c in numbers})
    return typed.dropna(subset=["event_time", "latitude", "longitude", "magnitude"]).withColumn(
        "event_us", F.unix_micros("event_time")
    )


def normalize_usgs_columns(df: DataFrame) -> DataFrame:
    """Feed column names to catalogue names, and the ISO time to Date and Time texts in UTC."""
    named = df.withColumnsRenamed({k: v for k, v in FEED_RENAMES.items() if k in df.columns})
    if "Date" not in named.columns:
        return named
    when = parse_event_time(F.col("Date").cast("string"))
    return named.withColumns({"Time": F.date_format(when, "HH:mm:ss"), "Date": F.date_format(when, "MM/dd/yyyy")})


def _unique_by_lower(columns: list[str]) -> dict[str, str]:
    return {c.strip().lower(): c for c in reversed(columns)}


def read_catalog_any(spark: SparkSession, path: str) -> DataFrame:
    """(event_us, latitude, longitude, magnitude) from any of the three known layouts.

    A missing required column is an error, a bad number or time drops the row.
    """
    raw = read_header_csv(spark, path)
    lower = _unique_by_lower(raw.columns)
    if {"datetime", "latitude", "longitude", "magnitude"} <= set(lower):
        when = parse_event_time(F.col(f"`{lower['datetime']}`"))
    elif {"Date", "Time", "Latitude", "Longitude", "Magnitude"} <= set(raw.columns):
        when = catalog_time(F.col("Date"), F.col("Time"))
    elif "datetime" in lower:
        when = parse_event_time(F.col(f"`{lower['datetime']}`"))
    elif {"date", "time"} <= set(lower):
        date, time = F.col(f"`{lower['date']}`"), F.col(f"`{lower['time']}`")
        when = F.coalesce(catalog_time(date, time), parse_event_time(F.concat_ws(" ", F.trim(date), F.trim(time))))
    else:
        raise ValueError(f"no usable time columns in {path}: {raw.columns}")

    found = {"latitude": lower.get("latitude"), "longitude": lower.get("longitude")}
    found["magnitude"] = lower.get("magnitude", lower.get("mag"))
    missing = sorted(k for k, v in found.items() if v is None)
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    typed = raw.select(
        F.unix_micros(when).alias("event_us"), *[number(F.col(f"`{v}`")).alias(k) for k, v in found.items()]
    )
    return typed.dropna()


def union_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Yearly or daily frames in one; columns missing in some chunk are NULL there."""
    if not chunks:
        raise ValueError("no chunks")
    out = chunks[0]
    for chunk in chunks[1:]:
        out = out.unionByName(chunk, allowMissingColumns=True)
    return out


def read_stress_csv(spark: SparkSession, path: str) -> DataFrame:
    """Usable stress stations from a Latin-1 file."""
    raw = read_header_csv(spark, path, encoding="ISO-8859-1")
    keep = {"LAT": "lat", "LON": "lon", "AZI": "azi"}
    typed = raw.withColumnsRenamed({**keep, "REGIME": "regime", "QUALITY": "quality"})
    return usable_stations(typed.withColumns({c: number(F.col(c)) for c in keep.values()}))
