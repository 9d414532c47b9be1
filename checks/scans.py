"""Readers and writers, as round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, r
from epicell.fixtures import with_views
from epicell.operators.audits import dataset_manifest
from epicell.session import shared_dir
from epicell.sources import catalogs, geojson, tables

WC = with_views("catalog")
NUMBERS = ", ".join(f"{r(c)} AS {c}" for c in ("latitude", "longitude", "depth", "magnitude"))
TO_SECOND = "event_us // 1000000 * 1000000"
TO_MILLI = "event_us // 1000 * 1000"


def catalog_csv(t, gz: bool = False) -> str:
    """The catalogue as a file with Date and Time columns; some times and numbers are spoilt."""
    ts = F.timestamp_micros("event_us")
    path = shared_dir(t.spark, "catalog-csv")
    t.catalog.select(
        F.when(F.col("event_id") % 101 == 0, "not a date").otherwise(F.date_format(ts, "MM/dd/yyyy")).alias("Date"),
        F.date_format(ts, "HH:mm:ss").alias(" Time "),
        F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"),
        F.col("depth").alias("Depth"),
        F.when(F.col("event_id") % 103 == 0, "bad").otherwise(F.col("magnitude").cast("string")).alias("Magnitude"),
        F.col("mag_type").alias("Magnitude Type"),
        F.col("type").alias("Type"),
        F.col("event_id").alias("ID"),
    ).write.csv(path, header=True, compression="gzip" if gz else "none", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@check(
    "read_catalog_csv",
    WC
    + f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {TO_SECOND} AS event_us, {NUMBERS}, mag_type, "type" FROM catalog
      WHERE event_id % 101 <> 0 AND event_id % 103 <> 0""",
)
def _(t):
    df = catalogs.read_catalog_csv(t.spark, catalog_csv(t))
    return df.select(
        F.col("ID").alias("event_id"), "event_us", "latitude", "longitude", "depth", "magnitude", "mag_type", F.col("Type").alias("type")
    )


def feed_frame(t):
    """The catalogue under feed names."""
    return t.catalog.select(
        F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"),
        "latitude",
        "longitude",
        "depth",
        F.col("magnitude").alias("mag"),
        F.col("mag_type").alias("magType"),
        "type",
        F.col("event_id").alias("id"),
        (F.col("event_id") % 360).cast("double").alias("gap"),
        (F.col("event_id") % 9).cast("double").alias("depthError"),
    )


@check(
    "normalize_usgs_columns",
    WC
    + f"""SELECT strftime(make_timestamp(event_us), '%m/%d/%Y') AS "Date", strftime(make_timestamp(event_us), '%H:%M:%S') AS "Time",
      {r('latitude')} AS "Latitude", {r('longitude')} AS "Longitude", {r('depth')} AS "Depth", {r('magnitude')} AS "Magnitude",
      mag_type AS "Magnitude Type", "type" AS "Type", event_id AS "ID", {r('event_id % 360')} AS "Azimuthal Gap", {r('event_id % 9')} AS "depthError" FROM catalog""",
)
def _(t):
    return catalogs.normalize_usgs_columns(feed_frame(t))


@check(
    "read_catalog_any",
    WC
    + f"""SELECT * FROM (SELECT 'datetime' AS layout, {TO_MILLI} AS event_us, {r('latitude')} AS latitude, {r('longitude')} AS longitude, {r('magnitude')} AS magnitude FROM catalog
      UNION ALL SELECT 'date_time', {TO_SECOND}, {r('latitude')}, {r('longitude')}, {r('magnitude')} FROM catalog WHERE event_id % 101 <> 0 AND event_id % 103 <> 0
      UNION ALL SELECT 'any_case', {TO_SECOND}, {r('latitude')}, {r('longitude')}, {r('magnitude')} FROM catalog)""",
)
def _(t):
    iso = F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    artefact = shared_dir(t.spark, "artefact")
    t.catalog.select(iso.alias("datetime"), "latitude", "longitude", "magnitude").write.csv(artefact, header=True, compression="gzip")
    odd = shared_dir(t.spark, "odd-case")
    ts = F.timestamp_micros("event_us")
    t.catalog.select(
        F.date_format(ts, "yyyy-MM-dd").alias("DATE"),
        F.date_format(ts, "HH:mm:ss").alias("tIME"),
        F.col("latitude").alias("LATITUDE"),
        F.col("longitude").alias("longitude"),
        F.col("magnitude").alias("Mag"),
    ).write.csv(odd, header=True)
    paths = {"datetime": artefact, "date_time": catalog_csv(t, gz=True), "any_case": odd}
    return catalogs.union_chunks(
        [catalogs.read_catalog_any(t.spark, p).withColumn("layout", F.lit(name)) for name, p in paths.items()]
    )


def event_docs(t) -> str:
    path = shared_dir(t.spark, "event-docs")
    geojson.write_event_docs(t.catalog, path, F.floor(F.col("event_id") / 500))
    return path


@check(
    "parse_geojson_events",
    WC + f"SELECT CAST(event_id AS VARCHAR) AS event_id, {TO_MILLI} AS event_us, {NUMBERS} FROM catalog WHERE magnitude >= 2",
)
def _(t):
    return geojson.parse_geojson_events(t.spark, event_docs(t), one_per_line=True)


@check(
    "parse_geojson_latest",
    WC
    + f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {TO_MILLI} AS event_us, {r('latitude')} AS latitude, {r('longitude')} AS longitude,
      {r('coalesce(depth, 33)')} AS depth, {r('magnitude')} AS magnitude FROM catalog WHERE magnitude >= 4
      ORDER BY {TO_MILLI} DESC, CAST(event_id AS VARCHAR) LIMIT 60""",
)
def _(t):
    return geojson.parse_geojson_latest(t.spark, event_docs(t), 60, one_per_line=True)


def line_docs(t) -> str:
    """One feature per line id in all four geometry types, and one feature without geometry."""
    at = F.array("lon", "lat", F.lit(7.5))
    lines = t.line_vertices.groupBy("line_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", at.alias("at")))).alias("v"), F.first("slip_type").alias("slip_type")
    )
    line = F.transform("v", lambda v: v["at"])
    kind = F.col("line_id") % 4
    text = (
        F.when(kind == 0, F.to_json(line))
        .when(kind.isin(1, 2), F.to_json(F.array(line)))
        .otherwise(F.to_json(F.array(F.array(line))))
    )
    name = F.element_at(F.array(*[F.lit(n) for n in geojson.ALL_TYPES]), (kind + 1).cast("int"))
    shape = F.format_string('{"type":"%s","coordinates":%s}', name, text)
    shown = F.format_string(
        '{"features":[{"type":"Feature","id":"%d","properties":{"slip_type":"%s"},"geometry":%s},'
        '{"type":"Feature","id":"none","properties":{},"geometry":null}]}',
        F.col("line_id"),
        F.col("slip_type"),
        shape,
    )
    path = shared_dir(t.spark, "line-docs")
    lines.select(shown.alias("value")).write.text(path)
    return path


VERTICES = """, n AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) - 1 AS pos FROM line_vertices)
    SELECT CAST(line_id AS VARCHAR) AS feature_id, 0 AS part, CAST(pos AS INT) AS seq, {lat} AS lat, {lon} AS lon, slip_type FROM n {where}"""


@check("parse_geojson_vertices", with_views("line_vertices") + VERTICES.format(lat=r("lat"), lon=r("lon"), where=""))
def _(t):
    return geojson.parse_geojson_vertices(t.spark, line_docs(t), one_per_line=True)


@check(
    "parse_geojson_vertices_plates",
    with_views("line_vertices") + VERTICES.format(lat=r("lat"), lon=r("lon"), where="WHERE line_id % 4 IN (0, 1)"),
)
def _(t):
    return geojson.parse_geojson_vertices(t.spark, line_docs(t), geojson.PLATE_TYPES, one_per_line=True)


@check(
    "read_stress_csv",
    with_views("stations")
    + f"""SELECT CAST(station_id AS VARCHAR) AS "ID", {r('lat')} AS lat, {r('lon')} AS lon, {r('azi')} AS azi, trim(regime) AS regime, quality, 'Müller' AS "AUTHOR"
      FROM stations WHERE quality IN ('A', 'B', 'C') AND azi IS NOT NULL""",
)
def _(t):
    path = shared_dir(t.spark, "stress-csv")
    t.stations.select(
        F.col("station_id").alias("ID"),
        F.col("lat").alias(" LAT"),
        F.col("lon").alias("LON "),
        F.col("azi").alias("AZI"),
        F.col("regime").alias("REGIME"),
        F.col("quality").alias("QUALITY"),
        F.lit("Müller").alias("AUTHOR"),
    ).write.csv(path, header=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return catalogs.read_stress_csv(t.spark, path).withColumn("regime", F.trim("regime"))


@check(
    "write_dataset",
    WC + f"SELECT event_id, event_us, {NUMBERS}, CAST(year(make_timestamp(event_us)) AS INT) AS year FROM catalog WHERE year(make_timestamp(event_us)) >= 2010",
)
def _(t):
    path = shared_dir(t.spark, "dataset")
    dated = t.catalog.withColumn("year", F.year(F.timestamp_micros("event_us")))
    # one writer per year keeps the file count low; a large year is split by the adaptive rebalance
    tables.write_dataset(dated.hint("rebalance", F.col("year")), path, ["year"])
    return t.spark.read.parquet(path).where("year >= 2010").select(
        "event_id", "event_us", "latitude", "longitude", "depth", "magnitude", "year"
    )


META = ("mlp_v1__full__keras", "benchmark_v2", "mlp_full_v1", "dataset_v5_dedup", "")
META_COLS = ("model_version", "benchmark_id", "feature_set_version", "dataset_version", "mlflow_run_id")
META_SQL = ", ".join(f"'{v}' AS {c}" for v, c in zip(META, META_COLS))


@check("add_serving_metadata", with_views("scored") + f"SELECT prediction_id, event_id, {META_SQL} FROM scored")
def _(t):
    return tables.add_serving_metadata(t.scored.select("prediction_id", "event_id"), dict(zip(META_COLS, META)))


@check(
    "upsert_scored_events",
    with_views("scored")
    + f""", w AS (SELECT event_id, prediction_id, scored_us, prob_7d, CASE WHEN prediction_id % 3 = 0 THEN {META_SQL.split(' AS ')[0]} ELSE model_version END AS model_version,
        CASE WHEN prediction_id % 3 = 0 THEN 3 END AS features_used FROM scored)
      SELECT event_id, prediction_id, scored_us, {r('prob_7d')} AS prob_7d, model_version, features_used FROM w
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY scored_us DESC, prediction_id DESC) = 1""",
)
def _(t):
    s = t.scored.select("event_id", "prediction_id", "scored_us", "prob_7d", "model_version")
    batch = s.where("prediction_id % 3 = 0").withColumn("features_used", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    merged = tables.upsert_scored_events(
        s.where("prediction_id % 3 <> 0"), tables.features_used_as_int(batch), meta=dict(zip(META_COLS, META))
    )
    return merged.select("event_id", "prediction_id", "scored_us", "prob_7d", "model_version", "features_used")


@check(
    "append_prediction_log",
    with_views("scored") + f"SELECT prediction_id, event_id, scored_us, {r('prob_7d')} AS prob_7d, {r('prob_30d')} AS prob_30d, {META_SQL} FROM scored",
)
def _(t):
    path = shared_dir(t.spark, "log")
    rows = t.scored.drop("model_version")
    for part in (0, 1):
        batch = rows.where(F.col("prediction_id") % 2 == part).withColumn("prob_365d", F.lit(0.5))
        tables.append_prediction_log(tables.add_serving_metadata(batch, dict(zip(META_COLS, META))), path)
    return t.spark.read.parquet(path).select("prediction_id", "event_id", "scored_us", "prob_7d", "prob_30d", *META_COLS)


WIDE_COLS = (
    "l_orderkey l_linenumber count_7d energy_7d rate_7d b_value_7d elapsed_since_last_s gap all_null constant_col"
    " not_constant_with_null text_col label_7d"
).split()


@check(
    "dataset_manifest",
    with_views("wide")
    + ", f AS (SELECT count(*) AS n, "
    + ", ".join(f"count(*) - count({c}) AS n_{c}" for c in WIDE_COLS)
    + f", min(l_orderkey) AS lo, max(l_orderkey) AS hi, avg(label_7d) AS pr FROM wide), l AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, n_{c} / n AS rate FROM f" for c in WIDE_COLS)
    + f""") SELECT n AS rows, lo AS time_min, hi AS time_max, {r('pr')} AS positive_rate_label_7d, {len(WIDE_COLS)} AS column_count,
      '{','.join(WIDE_COLS)}' AS columns, (SELECT string_agg(c || printf('=%.4f', rate), ',' ORDER BY rate DESC, c) FROM (SELECT * FROM l ORDER BY rate DESC, c LIMIT 20)) AS top_null_rates,
      'a,b' AS dropped_exact FROM f""",
)
def _(t):
    return dataset_manifest(t.wide, "l_orderkey", ["label_7d"], {"exact": ["a", "b"]})
