"""State of the streams by slots: many keys, few calls of the store."""

from pyspark.sql import Row

from epicell.constants import DAY_US
from epicell.streaming.state import DUE, GONE, OPENED, SHIFT_US, LastArrival, OpenOutcome


class Store:
    """One slot: its value, its timers, and the number of calls."""

    def __init__(self):
        self.value, self.timers, self.calls, self.now = None, set(), 0, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def advance(self, processor, day):
        """The watermark moves on; all timers behind it go off."""
        self.now = (SHIFT_US + day * DAY_US) // 1000
        out = []
        for at in sorted(t for t in self.timers if t < self.now):
            self.at = at
            out += processor.handleExpiredTimer((0,), self, self)
            self.timers.discard(at)
        return out

    def getExpiryTimeInMs(self):
        return self.at


def prediction(name, day):
    us = None if day is None else int(day * DAY_US)
    return Row(prediction_id=name, event_id="e", event_us=us, latitude=1.0, longitude=None)


def test_predictions_of_a_slot_share_the_calls_of_the_store():
    store = Store()
    job = OpenOutcome({"30d": 30, "7d": 7}, "")
    job.init(store)
    many = [prediction(f"p{i}", i / 1000) for i in range(1000)]
    out = list(job.handleInputRows((0,), iter(many), store))
    assert [(r.prediction_id, r[DUE]) for r in out] == [(p.prediction_id, OPENED) for p in many]
    assert store.calls <= 4
    store.calls = 0
    assert sorted(r.prediction_id for r in store.advance(job, 7.5)) == sorted(f"p{i}" for i in range(500))
    assert store.calls <= 4
    # known ones, one without a time, one twice and late: only the last is new, by its earlier time
    again = [prediction("p1", 0), prediction("n", None), prediction("late", -2), prediction("late", -3)]
    assert [(r.prediction_id, r.event_us) for r in job.handleInputRows((0,), iter(again), store)] == [("late", -3 * DAY_US)]
    assert [(r.prediction_id, r[DUE]) for r in store.advance(job, 7.5)] == [("late", "7d")]
    out = store.advance(job, 50)
    assert sorted((r.prediction_id, r[DUE]) for r in out) == sorted(
        [(f"p{i}", "7d") for i in range(500, 1000)] + [(f"p{i}", "30d") for i in range(1000)] + [("late", "30d")]
    )
    assert store.value is None and not store.timers


def arrival(name, day, magnitude):
    return Row(event_id=name, event_us=int(day * DAY_US), magnitude=magnitude)


def test_events_of_a_slot_share_the_calls_of_the_store():
    store = Store()
    job = LastArrival(["event_id", "event_us", "magnitude"], "string")
    job.init(store)
    many = [arrival(f"e{i}", i / 1000, 4.0) for i in range(1000)] + [arrival("e0", 0, 5.0), arrival("e1", 0, 9.0), arrival("e2", 0.002, None)]
    out = list(job.handleInputRows((0,), iter(many), store))
    assert [(r.event_id, r.magnitude) for r in out] == [("e0", 5.0)] + [(f"e{i}", 4.0) for i in range(1, 1000)]
    assert store.calls <= 4
    # the first of all is moved beyond the others
    list(job.handleInputRows((0,), iter([arrival("e0", 3, 4.0)]), store))
    store.calls = 0
    out = store.advance(job, 0.5005)
    assert sorted(r.event_id for r in out) == sorted(f"e{i}" for i in range(1, 501)) and all(r[GONE] for r in out)
    assert store.calls <= 4
    assert len(store.advance(job, 2)) == 499
    assert [r.event_id for r in store.advance(job, 4)] == ["e0"]
    assert store.value is None and not store.timers
