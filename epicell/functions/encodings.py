"""Categorical encodings and simple derived columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: names and codes used by the published system ----
SEASON_BY_MONTH = {
    12: "Hiver", 1: "Hiver", 2: "Hiver",
    3: "Printemps", 4: "Printemps", 5: "Printemps",
    6: "Été", 7: "Été", 8: "Été",
    9: "Automne", 10: "Automne", 11: "Automne",
}
DEPTH_CATEGORIES = ("superficiel", "intermédiaire", "profond")
SLIP_CODES = {
    "normal": 1,
    "reverse": 2,
    "thrust": 2,
    "strike-slip": 3,
    "sinistral": 3,
    "dextral": 3,
    "oblique": 4,
    "blind thrust": 2,
}
SLIP_COLUMNS = ("slip_type", "slip_type_1", "rake", "type")
REGIME_CODES = {"NF": 0, "TF": 1, "SS": 2, "NS": 3, "TS": 3, "U": 4}
UNKNOWN_REGIME = 4
QUALITY_CODES = {"A": 4, "B": 3, "C": 2, "D": 1, "E": 0}
ZONE_NAMES = {
    (0, 125): "Sulawesi, Indonésie",
    (35, 140): "Honshu, Japon",
    (-25, -180): "Tonga",
    (-20, -180): "Fidji-Tonga",
    (-10, 150): "Papouasie-Nvl-Guinée",
    (5, 125): "Mindanao, Philippines",
    (35, 70): "Hindu Kush, Afghanistan",
    (-25, -70): "Atacama, Chili",
    (-35, -180): "Kermadec, NZ",
    (-15, 165): "Vanuatu",
    (-10, 125): "Timor, Indonésie",
    (-20, -175): "Tonga Sud",
    (-35, -75): "Biobío, Chili",
    (20, 120): "Taïwan",
    (-20, 165): "Nouvelle-Calédonie",
}
# ---- end of fixed values ----


def code_map(codes: dict, key: Column, default) -> Column:
    """Constant lookup table folded into the expression."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(codes.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def season(date: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(SEASON_BY_MONTH.items())])
    return F.try_element_at(table, F.month(date))


def depth_category(depth: Column) -> Column:
    shallow, middle, deep = DEPTH_CATEGORIES
    # a missing depth compares false twice in the published system and lands in the last class
    return F.when(depth < 70, shallow).when(depth <= 300, middle).otherwise(deep)


def encode_depth_ordinal(category: Column) -> Column:
    out = F.lit(None).cast("int")
    for code, name in enumerate(DEPTH_CATEGORIES):
        out = F.when(category == name, code).otherwise(out)
    return out


def encode_slip(text: Column) -> Column:
    return code_map(SLIP_CODES, F.lower(F.trim(text)), 0)


def slip_column(columns: list[str]) -> str | None:
    """The first slip-like column present, in the fixed order of preference."""
    return next((c for c in SLIP_COLUMNS if c in columns), None)


def encode_regime(text: Column) -> Column:
    return code_map(REGIME_CODES, F.trim(text), UNKNOWN_REGIME)


def encode_quality(text: Column) -> Column:
    return code_map(QUALITY_CODES, F.trim(text), 0)


def azimuth_sin_cos(deg: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(deg)), F.cos(F.radians(deg))


def grid_label(lat_bin: Column, lon_bin: Column) -> Column:
    """Name of a five-degree zone, else its corner written with hemispheres."""
    key = F.concat_ws("|", lat_bin.cast("int").cast("string"), lon_bin.cast("int").cast("string"))
    names = {f"{lat}|{lon}": name for (lat, lon), name in ZONE_NAMES.items()}
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(names.items())])
    plain = F.format_string(
        "%d°%s / %d°%s",
        F.abs(lat_bin.cast("int")),
        F.when(lat_bin >= 0, "N").otherwise("S"),
        F.abs(lon_bin.cast("int")),
        F.when(lon_bin >= 0, "E").otherwise("W"),
    )
    return F.coalesce(F.try_element_at(table, key), plain)


def one_hot(df: DataFrame, col: str, prefix: str, values: list[str]) -> DataFrame:
    """One int column per known value; an unknown value gives zeros everywhere."""
    return df.withColumns(
        {f"{prefix}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values}
    )
