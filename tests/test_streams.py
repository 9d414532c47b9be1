"""Streams over several triggers."""

import json
import os

import pytest

from pyspark.sql import functions as F

from epicell.session import shared_dir
from epicell.sources.keyed import KeyedTable
from epicell.streaming.catalog import rolling_rows, stream_dedup, stream_ingest_events, stream_rolling_catalog
from epicell.streaming.serving import HealthJob, OutcomeJob

DAY_MS = 86_400_000


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_events_reported_late_are_kept(spark):
    path, out, checkpoint = (shared_dir(spark, p) for p in ("in", "out", "checkpoint"))
    os.makedirs(path)
    for i, (event, day) in enumerate([("a", 0), ("b", 10), ("c", 1), ("a", 0), ("d", 11), ("e", -400)]):
        feature = {"id": event, "properties": {"time": 1_700_000_000_000 + day * DAY_MS, "mag": 5.0}, "geometry": {"coordinates": [1.0, 2.0, 3.0]}}
        name = f"{path}/{i}.json"
        with open(name, "w") as f:
            json.dump({"features": [feature]}, f)
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = stream_dedup(stream_ingest_events(spark, path, one_per_line=True, files_per_trigger=1))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d", "e"]


def test_a_failed_run_is_logged_and_raises_the_alert(spark):
    def step(batch, batch_no):
        if batch_no == 1:
            raise RuntimeError("publishing failed")

    now = 1_700_000_000_000_000
    job = HealthJob(spark, shared_dir(spark, "runs"), "scoring", lambda: now, step)
    events = spark.createDataFrame([(now - 1,)], "event_us long")
    job(events, 0)
    with pytest.raises(RuntimeError):
        job(events, 1)
    assert {(r.batch_no, r.success, r.published_rows) for r in job.runs().collect()} == {(0, True, 1), (1, False, 0)}


def write_rows(path, number, rows):
    os.makedirs(path, exist_ok=True)
    name = f"{path}/{number}.json"
    with open(name, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.utime(name, (1_700_000_000 + number, 1_700_000_000 + number))


def test_rolling_catalogue_after_revisions_and_restarts(spark):
    day = 86_400_000_000
    path, state = shared_dir(spark, "in"), shared_dir(spark, "state")
    table = KeyedTable(spark, shared_dir(spark, "rolling"), "event_id", buckets=2)
    batches = [
        [("a", 0, 5.0), ("b", 10, 4.0), ("c", 11, 3.0)],
        [("b", 12, 4.5), ("d", 60, 3.0), ("c", 11, 3.0), ("c", 11, 3.5)],  # revised; twice in one poll
        [("e", 104, 5.0), ("a", 1, 5.5)],  # a late revision of what the window has left
        [("d", 60, 1.0), ("f", 130, 2.0)],  # too small now
    ]
    want, newest = {}, 0
    for number, rows in enumerate(batches):
        write_rows(path, number, [{"event_id": e, "event_us": d * day, "magnitude": m} for e, d, m in rows])
        for e, d, m in sorted(rows, key=lambda r: r[1:]):
            want[e] = (d, m)
        events = spark.readStream.schema("event_id string, event_us long, magnitude double").json(path)
        stream_rolling_catalog(events, table, state).awaitTermination()
        newest = max(d for d, _ in want.values())
        got = {r.event_id: (r.event_us // day, r.magnitude) for r in rolling_rows(table).collect()}
        assert got == {e: v for e, v in want.items() if newest - 92 <= v[0] and v[1] >= 2}
    # what is far behind is gone from the table itself, not only from the view
    write_rows(path, 9, [{"event_id": "z", "event_us": 400 * day, "magnitude": 4.0}])
    events = spark.readStream.schema("event_id string, event_us long, magnitude double").json(path)
    stream_rolling_catalog(events, table, state).awaitTermination()
    assert {r.event_id for r in table.read().collect()} == {"z"}


def test_outcomes_become_due_over_batches_and_a_restart(spark):
    day = 86_400_000_000
    log_path, tick_path, state = (shared_dir(spark, p) for p in ("log", "ticks", "state"))
    catalog = spark.createDataFrame(
        [("q1", 103 * day, 10.0, 10.0, 5.5), ("q2", 120 * day, 10.0, 10.0, 5.0), ("q3", 103 * day, 50.0, 50.0, 5.5)],
        "event_id string, event_us long, latitude double, longitude double, magnitude double",
    )
    clock = {"now": 0}
    table = KeyedTable(spark, shared_dir(spark, "outcomes"), "outcome_id", buckets=2)
    job = OutcomeJob(spark, lambda: catalog, table, lambda: clock["now"])
    asked = []
    real = job.resolve
    job.resolve = lambda rows: (asked.append(sorted((r.prediction_id, r.due) for r in rows.collect())), real(rows))

    def at(number, when, rows):
        clock["now"] = when * day
        write_rows(log_path, number, [dict(zip(("prediction_id", "event_id", "event_us", "latitude", "longitude"), r)) for r in rows])
        write_rows(tick_path, number, [{"now_us": when * day}])
        log = spark.readStream.schema("prediction_id string, event_id string, event_us long, latitude double, longitude double").json(log_path)
        ticks = spark.readStream.schema("now_us long").json(tick_path)
        del asked[:]
        job.start(log, state, ticks, seen=F.timestamp_micros(F.lit(when * day))).awaitTermination()
        return {r.prediction_id: (r.label_7d, r.label_30d) for r in job.read().collect()}

    near, far = (100 * day, 10.0, 10.5), (100 * day, -20.0, 0.0)
    assert at(0, 101, [("p1", "e1", *near), ("p2", "e2", *far)]) == {"p1": (None, None), "p2": (None, None)}
    # logged again: nothing happens; a new one comes late and is due at once
    assert at(1, 108, [("p1", "e1", *near), ("p3", "e3", *near)]) == {"p1": (True, None), "p2": (False, None), "p3": (True, None)}
    assert sum(asked, []).count(("p1", "7d")) == 1 and ("p1", "opened") not in sum(asked, [])
    assert at(2, 140, []) == {"p1": (True, True), "p2": (False, False), "p3": (True, True)}
    assert sorted(sum(asked, [])) == [("p1", "30d"), ("p2", "30d"), ("p3", "30d")]
    assert at(3, 150, []) == {"p1": (True, True), "p2": (False, False), "p3": (True, True)} and sum(asked, []) == []
