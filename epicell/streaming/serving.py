"""Scoring, delayed outcomes and health as micro-batch jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epicell.constants import DEFAULT_DEPTH_KM, MIN_MAG_WINDOW
from epicell.operators.audits import freshness_alerts
from epicell.operators.cleaning import validate_event_input
from epicell.operators.followups import followup_exists
from epicell.operators.serving import VALID_HORIZONS, unscored_events
from epicell.operators.shape import pick_last
from epicell.plans.features import Geology, compute_features
from epicell.plans.scoring import score_batch
from epicell.session import scratch, settle
from epicell.sources.keyed import KeyedTable
from epicell.sources.tables import _fs, add_serving_metadata, append_prediction_log, serving_metadata
from epicell.streaming.state import DUE, OPENED, due_outcomes


def _run(stream: DataFrame, step, checkpoint: str, available_now: bool, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 minutes")).start()


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    fs, where = _fs(spark, path)
    return spark.read.parquet(path) if fs.exists(where) else None


@dataclass
class ScoringJob:
    """Scores events that this model has not logged yet.

    All new events of a batch are taken, invalid ones are left out instead of stopping it.
    The scores are written once before the two sinks read them. The read model is keyed by
    event and the log is checked first, so a repeated batch adds nothing.
    """

    spark: SparkSession
    rolling: Callable[[], DataFrame]
    hist: DataFrame
    geology: Geology
    scorer: Callable[[DataFrame], DataFrame]
    read_model: KeyedTable
    log_path: str
    now_us: Callable[[], int]
    meta: dict[str, str] | None = None

    def new_events(self, batch: DataFrame) -> DataFrame:
        strong = batch.where(F.col("magnitude") >= MIN_MAG_WINDOW)
        once = pick_last(strong, ["event_id"], [F.col("event_us"), F.col("magnitude")])
        filled = once.withColumn("depth", F.coalesce("depth", F.lit(DEFAULT_DEPTH_KM)))
        valid = validate_event_input(filled).where("valid").drop("valid", "reason")
        log = read_log(self.spark, self.log_path)
        version = (serving_metadata() | (self.meta or {}))["model_version"]
        return valid if log is None else unscored_events(valid, log, version)

    def __call__(self, batch: DataFrame, batch_no: int) -> None:
        with scratch(self.spark):
            self.score(batch, batch_no)

    def score(self, batch: DataFrame, batch_no: int) -> None:
        events = settle(self.new_events(batch), "new-events")
        if events.isEmpty():
            return
        features = compute_features(events, self.rolling(), self.hist, self.geology)
        scores = score_batch(features, self.scorer)
        place = events.select("event_id", "event_us", "latitude", "longitude", "depth", "magnitude")
        rows = place.join(scores, "event_id").withColumn("scored_us", F.lit(self.now_us()))
        rows = add_serving_metadata(rows, self.meta).withColumn("batch_id", F.lit(batch_no))
        rows = settle(rows.withColumn("prediction_id", F.expr("uuid()")), "scores")
        self.read_model.merge(rows.drop("prediction_id", "batch_id"), ["scored_us"])
        append_prediction_log(rows, self.log_path)

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        return _run(events, self, checkpoint, available_now)


OUTCOME_KEY = "outcome_id"


@dataclass
class OutcomeJob:
    """Opens outcomes for newly logged predictions and fills labels whose horizon has passed.

    Every prediction has a timer for each horizon in the state of the stream, so a batch looks at what has become due
    and at nothing else. The table has a row for each prediction and horizon; `read` puts them side by side.
    A filled label is never looked at again.
    """

    spark: SparkSession
    catalog: Callable[[], DataFrame]
    outcomes: KeyedTable
    now_us: Callable[[], int]

    def __call__(self, rows: DataFrame, batch_no: int) -> None:
        with scratch(self.spark):
            self.resolve(settle(rows, "due"))

    def resolve(self, rows: DataFrame) -> None:
        if rows.isEmpty():
            return
        now = self.now_us()
        kept = ["prediction_id", "event_id", "event_us", "latitude", "longitude"]
        parts = []
        for h in VALID_HORIZONS:
            here = rows.where(F.col(DUE).isin(OPENED, h)).select(*kept, (F.col(DUE) == h).alias("is_due"))
            due = here.where("is_due").select(F.col("prediction_id").alias("event_id"), "event_us", "latitude", "longitude")
            hits = followup_exists(due, self.catalog(), int(h[:-1])).select(F.col("event_id").alias("prediction_id"), F.col("has_followup").alias("label"))
            filled = here.where("is_due").join(hits, "prediction_id").withColumn("evaluated_us", F.lit(now).cast("bigint"))
            opened = here.where("NOT is_due").withColumns(
                {"label": F.lit(None).cast("boolean"), "evaluated_us": F.lit(None).cast("bigint")}
            )
            parts.append(filled.unionByName(opened).drop("is_due").withColumn("horizon", F.lit(h)))
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        keyed = both.withColumn(OUTCOME_KEY, F.concat_ws("|", "horizon", "prediction_id"))
        # an evaluated row comes after the open one
        self.outcomes.merge(keyed.withColumn("updated_us", F.coalesce("evaluated_us", F.lit(0).cast("bigint"))), ["updated_us"])

    def read(self) -> DataFrame | None:
        """One row per prediction with the label and the instant of evaluation of every horizon."""
        rows = self.outcomes.read()
        if rows is None:
            return None
        labels = {f"{new}_{h}{end}": (old, h) for h in VALID_HORIZONS for new, old, end in (("label", "label", ""), ("evaluated", "evaluated_us", "_us"))}
        own = [F.max(F.when(F.col("horizon") == h, F.col(old))).alias(name) for name, (old, h) in labels.items()]
        return rows.groupBy("prediction_id", "event_id", "event_us", "latitude", "longitude").agg(*own)

    def start(
        self, new_log: DataFrame, checkpoint: str, ticks: DataFrame | None = None, seen: Column | None = None, available_now: bool = True
    ) -> StreamingQuery:
        """`ticks` (column `now_us`) tells the time when nothing is predicted; `seen` is the time of a logged row."""
        arrived = F.current_timestamp() if seen is None else seen
        due = due_outcomes(new_log, ticks, {h: int(h[:-1]) for h in VALID_HORIZONS}, arrived)
        return _run(due, self, checkpoint, available_now, "update")


@dataclass
class HealthJob:
    """Runs a step on every batch, appends one run row, and exposes the alerts on the run log.

    A step that fails gets its row as well, with success false and nothing published, and the error goes
    on to the stream.
    """

    spark: SparkSession
    log_path: str
    pipeline_name: str
    now_us: Callable[[], int]
    step: Callable[[DataFrame, int], None] | None = None

    def __call__(self, batch: DataFrame, batch_no: int) -> None:
        try:
            if self.step is not None:
                self.step(batch, batch_no)
            facts = batch.agg(F.count(F.lit(1)).alias("published_rows"), F.max("event_us").alias("newest_event_us"))
            self._log(facts, batch_no, True)
        except Exception:
            nothing = self.spark.range(1).select(
                F.lit(0).cast("bigint").alias("published_rows"), F.lit(None).cast("bigint").alias("newest_event_us")
            )
            self._log(nothing, batch_no, False)
            raise

    def _log(self, facts: DataFrame, batch_no: int, success: bool) -> None:
        row = facts.select(
            F.lit(self.pipeline_name).alias("pipeline_name"),
            F.lit(batch_no).cast("bigint").alias("batch_no"),
            F.lit(self.now_us()).cast("bigint").alias("finished_us"),
            F.lit(success).alias("success"),
            "published_rows",
            "newest_event_us",
        )
        # a repeated batch rewrites its own folder
        row.write.mode("overwrite").parquet(f"{self.log_path}/pipeline={self.pipeline_name}/batch={batch_no}")

    def runs(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(self.log_path)

    def alerts(self, now_us: int, scheduler_up: bool = True) -> DataFrame:
        return freshness_alerts(self.runs(), now_us, scheduler_up)

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        return _run(events, self, checkpoint, available_now)
