"""The scalar functions as SQL functions for `spark.sql` users."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from epicell.constants import EARTH_KM, MERCATOR_M
from epicell.functions.scoring import CLAMP, RISK_BANDS, RISK_UNKNOWN


def _bands() -> str:
    steps = " ".join(f"WHEN p < {top}D THEN '{code}'" for top, _, code in RISK_BANDS[:-1])
    return f"CASE WHEN p IS NULL THEN '{RISK_UNKNOWN[1]}' {steps} ELSE '{RISK_BANDS[-1][2]}' END"


DEFINITIONS = {
    "haversine_km": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "DOUBLE",
        f"{2 * EARTH_KM}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "chord_to_km": (
        "chord DOUBLE",
        "DOUBLE",
        f"{2 * EARTH_KM}D * asin(greatest(0D, least(1D, chord / 2)))",
    ),
    "mercator_x": ("lon DOUBLE", "DOUBLE", f"radians(lon) * {MERCATOR_M}D"),
    "mercator_y": (
        "lat DOUBLE",
        "DOUBLE",
        f"ln(tan({math.pi / 4}D + radians(lat) / 2)) * {MERCATOR_M}D",
    ),
    "energy_term": ("m DOUBLE", "DOUBLE", "pow(10D, 1.5D * m)"),
    "temperature_scale": (
        "p DOUBLE, t DOUBLE",
        "DOUBLE",
        f"1D / (1D + exp(-ln(greatest({CLAMP}D, least(1D - {CLAMP}D, p))"
        f" / (1D - greatest({CLAMP}D, least(1D - {CLAMP}D, p)))) / t))",
    ),
    "risk_code": ("p DOUBLE", "STRING", _bands()),
}


def register(spark: SparkSession) -> None:
    """Create the functions for this session."""
    for name, (params, returns, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
