"""Event streams and the rolling catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epicell.constants import DAY_US, MIN_MAG_ROLLING, ROLLING_DAYS
from epicell.sources.geojson import EVENT_SCHEMA, clean_feed, feature_events
from epicell.sources.keyed import KeyedTable
from epicell.streaming.state import GONE, last_arrivals

# how far beyond the window a revision may move an event
REVISION_DAYS = 30


def stream_ingest_events(
    spark: SparkSession,
    path: str,
    min_mag: float = MIN_MAG_ROLLING,
    one_per_line: bool = False,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Typed events from feature-collection files as they arrive; the parser of the batch reader."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("multiLine", str(not one_per_line).lower())
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return clean_feed(feature_events(reader.json(path)), min_mag)


def stream_dedup(events: DataFrame, overlap: str = "2 days") -> DataFrame:
    """The first row per event_id among polls that overlap by at most `overlap`.

    The watermark is on the arrival: an event that is reported late, with an origin time long
    past, is as new as any other. State is kept for the overlap only. Later revisions go
    through the rolling catalogue.
    """
    arrived = events.withColumn("arrived", F.current_timestamp())
    return arrived.withWatermark("arrived", overlap).dropDuplicatesWithinWatermark(["event_id"]).drop("arrived")


def rolling_rows(table: KeyedTable, now_us: int | None = None, days: int = ROLLING_DAYS) -> DataFrame | None:
    """The last arrival of every event of the last `days` days, M >= 2.

    Without `now_us` the newest event is now, which makes a replay of old files meaningful.
    """
    rows = table.read()
    if rows is None:
        return None
    end = F.lit(now_us) if now_us is not None else rows.agg(F.max("event_us").alias("m")).scalar()
    kept = rows.withColumn("end_us", end)
    in_time = F.col("event_us").between(F.col("end_us") - days * DAY_US, F.col("end_us"))
    return kept.where(in_time & (F.col("magnitude") >= MIN_MAG_ROLLING)).drop("end_us")


def stream_rolling_catalog(
    events: DataFrame, table: KeyedTable, checkpoint: str, days: int = ROLLING_DAYS, available_now: bool = True
) -> StreamingQuery:
    """Maintain the rolling catalogue in a table kept by event; `rolling_rows` reads it.

    Each batch adds its own rows, and removes events that the window has left behind. A revision may move an
    event by up to REVISION_DAYS beyond the window; what is further back is ignored. A repeated batch changes nothing.
    """

    def write(batch: DataFrame, batch_no: int) -> None:
        if batch.isEmpty():
            return
        arrived = batch.withColumn("arrival", F.lit(batch_no).cast("bigint"))
        table.merge(arrived, ["arrival"], gone=F.col(GONE))

    changes = last_arrivals(events, days + REVISION_DAYS)
    writer = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 minutes")).start()
