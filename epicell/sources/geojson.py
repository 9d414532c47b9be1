"""GeoJSON event feeds and line files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epicell.constants import DEFAULT_DEPTH_KM, MIN_MAG_ROLLING, MIN_MAG_WINDOW
from epicell.functions.encodings import SLIP_COLUMNS

EVENT_SCHEMA = (
    "features array<struct<id string, properties struct<time bigint, mag double>,"
    " geometry struct<coordinates array<double>>>>"
)
LINE_SCHEMA = (
    "features array<struct<id string,"
    " properties struct<" + ", ".join(f"{c} string" for c in SLIP_COLUMNS) + ">,"
    " geometry struct<type string, coordinates string>>>"
)
PLATE_TYPES = ("LineString", "MultiLineString")
ALL_TYPES = ("LineString", "MultiLineString", "Polygon", "MultiPolygon")


def feature_events(docs: DataFrame) -> DataFrame:
    """One typed row per feature of an event feed; works on batches and streams alike."""
    feature = docs.select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return feature.select(
        F.col("f.id").alias("event_id"),
        (F.col("f.properties.time") * 1000).alias("event_us"),
        F.try_element_at(at, F.lit(2)).alias("latitude"),
        F.try_element_at(at, F.lit(1)).alias("longitude"),
        F.try_element_at(at, F.lit(3)).alias("depth"),
        F.col("f.properties.mag").alias("magnitude"),
    )


def clean_feed(events: DataFrame, min_mag: float = MIN_MAG_ROLLING) -> DataFrame:
    required = ["event_id", "event_us", "latitude", "longitude", "magnitude"]
    return events.dropna(subset=required).where(F.col("magnitude") >= min_mag)


def read_event_docs(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Feature collections, one per file or one per line."""
    return spark.read.schema(EVENT_SCHEMA).json(path, multiLine=not one_per_line)


def parse_geojson_events(
    spark: SparkSession, path: str, min_mag: float = MIN_MAG_ROLLING, one_per_line: bool = False
) -> DataFrame:
    return clean_feed(feature_events(read_event_docs(spark, path, one_per_line)), min_mag)


def parse_geojson_latest(spark: SparkSession, path: str, n: int, one_per_line: bool = False) -> DataFrame:
    """The n most recent M>=4 events ; a missing depth is 33 km."""
    events = clean_feed(feature_events(read_event_docs(spark, path, one_per_line)), MIN_MAG_WINDOW)
    filled = events.withColumn("depth", F.coalesce(F.col("depth"), F.lit(DEFAULT_DEPTH_KM)))
    return filled.orderBy(F.desc("event_us"), "event_id").limit(n)


def _parts(kind: Column, text: Column) -> Column:
    """Every geometry as an array of vertex lists."""
    line = F.from_json(text, "array<array<double>>")
    parts = F.from_json(text, "array<array<array<double>>>")
    nested = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    return (
        F.when(kind == "LineString", F.array(line))
        .when(kind.isin("MultiLineString", "Polygon"), parts)
        .when(kind == "MultiPolygon", nested)
    )


def parse_geojson_vertices(
    spark: SparkSession, path: str, geom_types: Sequence[str] = ALL_TYPES, one_per_line: bool = False
) -> DataFrame:
    """(feature_id, part, seq, lat, lon, slip_type): all vertices of the wanted geometry types."""
    docs = spark.read.schema(LINE_SCHEMA).json(path, multiLine=not one_per_line)
    feature = docs.select(F.explode("features").alias("f")).where(F.col("f.geometry.type").isin(*geom_types))
    slip = F.coalesce(*[F.col(f"f.properties.{c}") for c in SLIP_COLUMNS])
    parts = feature.select(
        F.col("f.id").alias("feature_id"),
        slip.alias("slip_type"),
        F.posexplode(_parts(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))).alias("part", "vertices"),
    )
    return parts.select("feature_id", "part", "slip_type", F.posexplode("vertices").alias("seq", "at")).select(
        "feature_id", "part", "seq", F.col("at")[1].alias("lat"), F.col("at")[0].alias("lon"), "slip_type"
    )


def write_event_docs(events: DataFrame, path: str, chunk: Column, mode: str = "errorifexists") -> None:
    """Feature collections for tests and exports, one per line; `chunk` groups a bounded number of events."""
    at = F.array("longitude", "latitude", "depth")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col("event_id").cast("string").alias("id"),
        F.struct(F.floor(F.col("event_us") / 1000).alias("time"), F.col("magnitude").alias("mag")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"),
    )
    docs = events.groupBy(chunk.alias("chunk")).agg(F.collect_list(feature).alias("features"))
    docs.select(F.lit("FeatureCollection").alias("type"), "features").write.mode(mode).json(path)
