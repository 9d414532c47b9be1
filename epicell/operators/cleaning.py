"""Row filters, validation and rule-driven cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicell.constants import MIN_MAG_DANGEROUS
from epicell.functions.timeparse import parse_event_time
from epicell.operators.shape import numeric_columns

INPUT_RANGES = {
    "latitude": (-90.0, 90.0),
    "longitude": (-180.0, 180.0),
    "depth": (0.0, 800.0),
    "magnitude": (0.0, 10.0),
}

CLEANING_RULES_V1 = {
    "time_column": "datetime",
    "target_columns": ["label_7d", "label_30d"],
    "drop_columns_exact": ["label_365d"],
    "drop_if_constant": True,
    "drop_if_all_null": True,
}
CLEANING_RULES_V2 = {
    **CLEANING_RULES_V1,
    "drop_columns_exact": [
        "label_365d",
        *[f"rate_{w}d" for w in (1, 7, 30, 90)],
        "ref_lat",
        "ref_lon",
        *[f"moment_{w}d" for w in (1, 7, 30, 90)],
    ],
}


def filter_event_type(df: DataFrame, col: str = "type", match: str = "trimmed") -> DataFrame:
    """Earthquakes only. `match`: "trimmed" ignores case and blanks, "lower" only case, "exact"
    wants the catalogue's spelling "Earthquake"."""
    text = F.col(col)
    if match == "exact":
        return df.where(text == "Earthquake")
    if match == "trimmed":
        text = F.trim(text)
    return df.where(F.lower(text) == "earthquake")


def validate_event_input(df: DataFrame) -> DataFrame:
    """Adds `valid` and `reason` (comma-separated names of missing or out-of-range inputs)."""
    faults = [
        F.when(F.col(c).isNull() | ~F.col(c).between(low, high), F.lit(c)) for c, (low, high) in INPUT_RANGES.items()
    ]
    reason = F.concat_ws(",", *faults)
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason") == "")


def drop_sparse_columns(df: DataFrame, frac: float = 0.5) -> DataFrame:
    """Keep a column when its non-NULL count reaches int(n * frac); one pass over the data."""
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    row = facts.first()
    needed = int(row["rows"] * frac)
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if row[f"n{i}"] >= needed])


def clean_basic(df: DataFrame, match: str = "lower") -> DataFrame:
    """Six columns, complete rows, earthquakes only, Dangerous = M >= 6."""
    six = df.select("event_us", "latitude", "longitude", "depth", "magnitude", "type").dropna()
    kept = filter_event_type(six, "type", match).drop("type")
    return kept.withColumn("Dangerous", (F.col("magnitude") >= MIN_MAG_DANGEROUS).cast("int"))


def apply_cleaning_rules(df: DataFrame, rules: dict) -> tuple[DataFrame, dict]:
    """The cleaned frame and its manifest (which columns went and why).

    Order: parse the time, drop the listed columns, drop all-NULL columns, drop constant
    columns (NULL counts as a value; time and targets are not exempt), keep time, targets and
    numeric columns, drop rows without time. All facts come from one aggregation.
    """
    time_col, targets = rules["time_column"], list(rules["target_columns"])
    if dict(df.dtypes)[time_col] == "string":
        df = df.withColumn(time_col, parse_event_time(F.col(time_col)))
    exact = [c for c in rules.get("drop_columns_exact", []) if c in df.columns]
    df = df.drop(*exact)

    facts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        value = F.col(f"`{c}`")
        facts += [F.count(value).alias(f"n{i}"), (F.min(value) == F.max(value)).alias(f"same{i}")]
    row = df.agg(*facts).first()
    all_null, constant = [], []
    for i, c in enumerate(df.columns):
        if row[f"n{i}"] == 0:
            all_null.append(c)
        elif row[f"n{i}"] == row["rows"] and row[f"same{i}"]:
            constant.append(c)
    if not rules.get("drop_if_all_null", False):
        # what is kept here still has one value only, and the next rule sees it
        constant, all_null = [c for c in df.columns if c in all_null + constant], []
    if not rules.get("drop_if_constant", False):
        constant = []
    df = df.drop(*all_null, *constant)

    numeric = set(numeric_columns(df))
    keep = [c for c in df.columns if c == time_col or c in targets or c in numeric]
    out = df.select(*keep)
    if time_col in keep:
        out = out.dropna(subset=[time_col])
    manifest = {
        "columns": keep,
        "column_count": len(keep),
        "target_columns": targets,
        "dropped_exact_columns": exact,
        "dropped_all_null_columns": all_null,
        "dropped_constant_columns": constant,
    }
    return out, manifest


def derive_year_month(df: DataFrame, us: str = "event_us") -> DataFrame:
    when = F.timestamp_micros(F.col(us))
    return df.withColumns({"Year": F.year(when), "Month": F.month(when)}).dropna(subset=["Year", "Month"])


def minmax_scale(df: DataFrame, col: str, a: float, b: float, out: str) -> DataFrame:
    """(x - min) / (max - min) * a + b; the extremes are one scalar subquery."""
    ends = df.agg(F.struct(F.min(col).alias("low"), F.max(col).alias("high")).alias("ends")).scalar()
    scaled = F.try_divide(F.col(col) - F.col("ends.low"), F.col("ends.high") - F.col("ends.low")) * a + b
    return df.withColumn("ends", ends).withColumn(out, scaled).drop("ends")


def clip(value: Column, low: float, high: float) -> Column:
    """Bounds a value and keeps NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])
