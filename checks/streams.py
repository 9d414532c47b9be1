"""Streams, run to the end of their input in a fresh folder; each equals a batch operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, hav, r
from checks.geo import CODES, band_sql, scale_sql
from checks.scans import NUMBERS, TO_MILLI, event_docs
from checks.training import geology
from epicell.fixtures import with_views
from epicell.session import shared_dir
from epicell.sources.geojson import write_event_docs
from epicell.sources.keyed import KeyedTable
from epicell.streaming.catalog import rolling_rows, stream_dedup, stream_ingest_events, stream_rolling_catalog
from epicell.streaming.serving import HealthJob, OutcomeJob, ScoringJob, read_log

WC = with_views("catalog")
DAY = 86_400_000_000


def to_table(stream, t):
    """Append a stream to a table until its input ends, and read the table."""
    path, state = shared_dir(t.spark, "stream-out"), shared_dir(t.spark, "stream-state")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path)


@check(
    "stream_ingest_events",
    WC + f"SELECT CAST(event_id AS VARCHAR) AS event_id, {TO_MILLI} AS event_us, {NUMBERS} FROM catalog WHERE magnitude >= 2",
)
def _(t):
    return to_table(stream_ingest_events(t.spark, event_docs(t), one_per_line=True, files_per_trigger=4), t)


def poll(t, path: str, again: bool) -> None:
    """One poll into the folder: all events, or half of them again with a larger magnitude."""
    events = t.catalog
    if again:
        events = events.where("event_id % 2 = 1").withColumn("magnitude", F.col("magnitude") + 0.25)
    write_event_docs(events, path, F.floor(F.col("event_id") / 500), mode="append")


@check("stream_dedup", WC + f"SELECT CAST(event_id AS VARCHAR) AS event_id, {TO_MILLI} AS event_us FROM catalog")
def _(t):
    # one trigger sees both polls; which copy comes first is not fixed, so only the key is compared
    path = shared_dir(t.spark, "polls")
    poll(t, path, again=False)
    poll(t, path, again=True)
    stream = stream_ingest_events(t.spark, path, one_per_line=True)
    return to_table(stream_dedup(stream), t).select("event_id", "event_us")


@check(
    "stream_rolling_catalog",
    WC
    + f""", m AS (SELECT max({TO_MILLI}) AS top FROM catalog)
      SELECT CAST(event_id AS VARCHAR) AS event_id, {TO_MILLI} AS event_us, {r('CASE WHEN event_id % 2 = 1 THEN magnitude + 0.25::DOUBLE ELSE magnitude END')} AS magnitude
      FROM catalog, m WHERE {TO_MILLI} >= top - 92 * {DAY}""",
)
def _(t):
    path, state = shared_dir(t.spark, "polls"), shared_dir(t.spark, "rolling-state")
    table = KeyedTable(t.spark, shared_dir(t.spark, "rolling"), "event_id", buckets=4)
    for again in (False, True):
        poll(t, path, again)
        # the same query, started again after its input has grown
        events = stream_ingest_events(t.spark, path, one_per_line=True)
        stream_rolling_catalog(events, table, state).awaitTermination()
    return rolling_rows(table).select("event_id", "event_us", "magnitude")


TOP = "(SELECT max(event_us) FROM catalog)"


def simple_scorer(features):
    """A stand-in model: probabilities from two features, by plain expressions."""
    raw = F.coalesce(F.col("magnitude"), F.lit(0.0)) / 10.0
    return features.withColumns({"raw_7d": raw, "raw_30d": raw / 2, "raw_365d": F.lit(None).cast("double")})


def keyed_events(t):
    """The catalogue with the key as text, as feeds have it."""
    return t.catalog.withColumn("event_id", F.col("event_id").cast("string"))


def event_stream(t, parts: int = 2):
    """All events as a stream that takes `parts` triggers."""
    path = shared_dir(t.spark, "events")
    rows = keyed_events(t)
    for k in range(parts):
        rows.where(F.abs(F.hash("event_id")) % parts == k).write.mode("append").parquet(path)
    files = len(t.spark.read.parquet(path).inputFiles())
    per_trigger = max(1, -(-files // parts))
    return t.spark.readStream.schema(t.spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


@check(
    "stream_score",
    WC
    + f""", e AS (SELECT *, {scale_sql('(magnitude / 10)', 0.6663)} AS p7, {scale_sql('(magnitude / 20)', 1.0357)} AS p30 FROM catalog WHERE magnitude >= 4)
      SELECT CAST(event_id AS VARCHAR) AS event_id, event_us, {r('coalesce(depth, 33)')} AS depth, {r('round(p7, 4)')} AS prob_7d, {r('round(p30, 4)')} AS prob_30d, {r('NULL')} AS prob_365d,
      {band_sql('p7', CODES, "'unknown'")} AS risk_7d_code, 67 AS features_used, 'm-test' AS model_version, 1 AS log_rows FROM e""",
)
def _(t):
    log_path = shared_dir(t.spark, "log")
    table = KeyedTable(t.spark, shared_dir(t.spark, "scored"), "event_id", buckets=4)
    job = ScoringJob(
        t.spark, lambda: t.catalog, t.catalog, geology(t), simple_scorer, table, log_path, lambda: 1_750_000_000_000_000,
        {"model_version": "m-test"},
    )
    job.start(event_stream(t), shared_dir(t.spark, "score-state")).awaitTermination()
    # a second run over the same events finds all of them logged
    job(keyed_events(t), 99)
    logged = read_log(t.spark, log_path).groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("log_rows"))
    kept = "event_id event_us depth prob_7d prob_30d prob_365d risk_7d_code features_used model_version".split()
    return table.read().select(*kept).join(logged, "event_id")


NEAR = f"abs(a.latitude - b.latitude) <= 1.8 AND {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 200"


def outcome_sql(h: int) -> str:
    return f"""CASE WHEN event_us + {h} * {DAY} <= {TOP} THEN EXISTS (SELECT 1 FROM catalog b WHERE b.magnitude >= 5 AND b.event_us >= a.us + 1000000
      AND b.event_us <= a.us + {h} * {DAY} AND {NEAR}) END"""


@check(
    "stream_outcomes",
    WC
    + f""", a AS (SELECT *, event_us // 1000000 * 1000000 AS us FROM catalog)
      SELECT CAST(event_id AS VARCHAR) AS event_id, {outcome_sql(7)} AS label_7d, {outcome_sql(30)} AS label_30d FROM a""",
)
def _(t):
    now = t.catalog.agg(F.max("event_us")).first()[0]
    outcomes = KeyedTable(t.spark, shared_dir(t.spark, "outcomes"), "outcome_id", buckets=4)
    log = event_stream(t).withColumn("prediction_id", F.concat(F.lit("p"), "event_id"))
    told, state = shared_dir(t.spark, "ticks"), shared_dir(t.spark, "outcome-state")
    job = OutcomeJob(t.spark, lambda: t.catalog, outcomes, lambda: now)
    # the predictions come 20 days before now; then the query is started again, and time passes without any
    for at in (now - 20 * DAY, now):
        t.spark.range(1).select(F.lit(at).cast("bigint").alias("now_us")).coalesce(1).write.mode("append").parquet(told)
        ticks = t.spark.readStream.schema("now_us long").parquet(told)
        job.start(log, state, ticks, F.timestamp_micros(F.lit(now - 20 * DAY))).awaitTermination()
    return job.read().select("event_id", "label_7d", "label_30d")


@check(
    "stream_health",
    WC + f"SELECT 'scoring_pipeline' AS pipeline_name, true AS stale, false AS failed, false AS scheduler_down, {r('5401')} AS age_s, (SELECT count(*) FROM catalog) AS published_rows",
)
def _(t):
    now = 1_750_000_000_000_000
    job = HealthJob(t.spark, shared_dir(t.spark, "runs"), "scoring_pipeline", lambda: now)
    job.start(event_stream(t), shared_dir(t.spark, "health-state")).awaitTermination()
    rows = job.runs().agg(F.sum("published_rows").alias("published_rows")).scalar()
    return job.alerts(now + 5401 * 1_000_000).drop("finished_us").withColumn("published_rows", rows)


