"""Keyed state with timers: what a rolling catalogue and open outcomes remember between batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epicell.constants import DAY_US

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GONE, DUE, OPENED = "gone", "due", "opened"
# watermarks begin at 1970: times are moved so far that no catalogue begins before
SHIFT_US = 1000 * 365 * DAY_US
# keys are kept in so many groups: few calls of the store in a large batch, little to read for one key in a small one
SLOTS = 1 << 13
SLOT = "slot"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Timers need the store that keeps state outside the JVM heap; a query fixes it in its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def slot_of(key: str) -> Column:
    """The group of keys that are kept together; null for a null key."""
    return F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int"))


def move_timer(handle: StatefulProcessorHandle, before: int | None, after: int | None) -> None:
    if before == after:
        return
    if before is not None:
        handle.deleteTimer(before)
    if after is not None:
        handle.registerTimer(after)


def over(timerValues, expiredTimerInfo) -> int:
    """The last millisecond whose timers go off in this batch: those behind the watermark."""
    return max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)


class LastArrival(StatefulProcessor):
    """For the events of a slot the last rows that came; a timer at the first origin time lets go what the watermark is past.

    A slot holds many keys, so a batch calls the store a few times a slot and not a few times a key.
    """

    def __init__(self, columns: list[str], kind: str):
        self.columns = columns
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.origins = handle.getValueState("origins", f"event_id array<{self.kind}>, event_us array<bigint>")

    def _at(self, event_us: int) -> int:
        return (event_us + SHIFT_US) // 1000 + 1

    def _held(self) -> dict:
        held = self.origins.get()
        return dict(zip(*held)) if held else {}

    def _first(self, held: dict) -> int | None:
        return self._at(min(held.values())) if held else None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # an event that comes twice in one poll: the later origin time, then the larger magnitude
        last = {}
        for row in rows:
            rank = (row["event_us"], row["magnitude"] is not None, row["magnitude"] or 0.0)
            known = last.get(row["event_id"])
            if known is None or rank > known[0]:
                last[row["event_id"]] = (rank, row)
        held = self._held()
        before = self._first(held)
        held.update((event, row["event_us"]) for event, (_, row) in last.items())
        self.origins.update((list(held), list(held.values())))
        move_timer(self.handle, before, self._first(held))
        for _, row in last.values():
            yield Row(**{c: row[c] for c in self.columns}, **{GONE: False})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = over(timerValues, expiredTimerInfo)
        held = self._held()
        kept = {event: us for event, us in held.items() if self._at(us) > upto}
        if kept:
            self.origins.update((list(kept), list(kept.values())))
            move_timer(self.handle, None, self._first(kept))
        else:
            self.origins.clear()
        for event in held.keys() - kept.keys():
            yield Row(**({c: None for c in self.columns} | {"event_id": event}), **{GONE: True})

    def close(self) -> None:
        pass


def last_arrivals(events: DataFrame, days: int) -> DataFrame:
    """Changes of the rolling catalogue: the last row of each event that came, and `gone` for one whose origin
    time is `days` days behind the newest. Rows further back than that are ignored."""
    keep_state_on_disk(events.sparkSession)
    timed = events.where(F.col("event_us").isNotNull() & F.col("event_id").isNotNull())
    timed = timed.withColumn("origin", F.timestamp_micros(F.col("event_us") + SHIFT_US)).withWatermark("origin", f"{days} days")
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in events.schema.fields], T.StructField(GONE, T.BooleanType())])
    kind = events.schema["event_id"].dataType.simpleString()
    timed = timed.withColumn(SLOT, slot_of("event_id"))
    return timed.groupBy(SLOT).transformWithState(LastArrival(events.columns, kind), schema, "Update", "EventTime")


PREDICTION = ["prediction_id", "event_id", "event_us", "latitude", "longitude"]


class OpenOutcome(StatefulProcessor):
    """For the predictions of a slot where and when they hold, and a timer for the horizon that is over first; with its
    last horizon a prediction is forgotten."""

    def __init__(self, horizons: dict[str, int], schema: str):
        self.horizons = sorted(horizons.items(), key=lambda h: h[1])
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getValueState("places", self.schema)

    def _at(self, event_us: int, days: int) -> int:
        """First millisecond at which the horizon is over."""
        return -(-(event_us + SHIFT_US + days * DAY_US) // 1000)

    def _held(self) -> dict:
        """By prediction its place and how many horizons are over."""
        held = self.places.get()
        return {row[0]: (row[1:-1], row[-1]) for row in zip(*held)} if held else {}

    def _first(self, held: dict) -> int | None:
        return min((self._at(place[1], self.horizons[told][1]) for place, told in held.values()), default=None)

    def _keep(self, held: dict) -> None:
        rows = [(prediction, *place, told) for prediction, (place, told) in held.items()]
        self.places.update(tuple(list(column) for column in zip(*rows)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # ticks
            return
        first = {}
        for row in rows:
            # one without a time is no prediction
            if row["event_us"] is None:
                continue
            known = first.get(row["prediction_id"])
            if known is None or row["event_us"] < known["event_us"]:
                first[row["prediction_id"]] = row
        if not first:
            return
        held = self._held()
        before = self._first(held)
        fresh = {p: tuple(row[c] for c in PREDICTION[1:]) for p, row in first.items() if p not in held}
        if not fresh:
            return
        held.update((p, (place, 0)) for p, place in fresh.items())
        self._keep(held)
        move_timer(self.handle, before, self._first(held))
        for prediction, place in fresh.items():
            yield self._row(prediction, place, OPENED)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = over(timerValues, expiredTimerInfo)
        kept, due = {}, []
        for prediction, (place, told) in self._held().items():
            while told < len(self.horizons) and self._at(place[1], self.horizons[told][1]) <= upto:
                due.append((prediction, place, self.horizons[told][0]))
                told += 1
            if told < len(self.horizons):
                kept[prediction] = (place, told)
        if kept:
            self._keep(kept)
            move_timer(self.handle, None, self._first(kept))
        else:
            self.places.clear()
        for row in due:
            yield self._row(*row)

    def _row(self, prediction, place: tuple, due: str) -> Row:
        return Row(**dict(zip(PREDICTION, (prediction, *place))), **{DUE: due})

    def close(self) -> None:
        pass


def shifted(time: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(time) + SHIFT_US).alias("seen")


def due_outcomes(log: DataFrame, ticks: DataFrame | None, horizons: dict[str, int], seen: Column) -> DataFrame:
    """Predictions as they are opened, and again with `due` = the name of each horizon when it is over.

    `seen` is the time at which a logged prediction arrives. `ticks` (column `now_us`) moves time on when nothing
    is predicted; without it time stands still until the next prediction.
    """
    keep_state_on_disk(log.sparkSession)
    kinds = {f.name: f.dataType for f in log.schema.fields}
    rows = log.where(F.col("prediction_id").isNotNull()).select(*PREDICTION, shifted(seen.cast("timestamp")))
    if ticks is not None:
        nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in PREDICTION]
        rows = rows.unionByName(ticks.select(*nothing, shifted(F.timestamp_micros("now_us"))))
    timed = rows.withWatermark("seen", "0 seconds")
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in PREDICTION], T.StructField(DUE, T.StringType())])
    held = ", ".join(f"{c} array<{kinds[c].simpleString()}>" for c in PREDICTION) + ", told array<int>"
    slots = timed.withColumn(SLOT, slot_of("prediction_id")).groupBy(SLOT)
    return slots.transformWithState(OpenOutcome(horizons, held), schema, "Update", "EventTime")
