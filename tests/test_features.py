"""What the feature jobs read of their inputs."""

from pyspark.sql import functions as F

from epicell.operators.followups import forward_labels
from epicell.plans.features import batch_features

EVENT = "event_id long, event_us long, latitude double, longitude double, depth double, magnitude double, mag_type string"
SEGMENT = "line_id int, seq int, lat_a double, lon_a double, lat_b double, lon_b double"


def counted(df, seen):
    """The frame, whose rows are counted each time they are read."""

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def rows(n):
    hour = 3_600_000_000
    return [(i, 1_000_000 * hour + i * 5 * hour, 10.0 + i % 7 / 10, 20.0, float(i % 50), 3.0 + i % 4 * 0.6, "mb" if i % 3 else None) for i in range(n)]


def test_inputs_are_read_once_for_all_searches(spark):
    """windows, elapsed time, codes and plates share one union of the catalogues."""
    events = spark.createDataFrame(rows(200), EVENT)
    plates = spark.createDataFrame([(1, 0, 9.0, 19.0, 11.0, 19.5)], SEGMENT)
    seen = spark.sparkContext.accumulator(0)
    targets = events.where("magnitude >= 4")
    out = batch_features(targets, counted(events.where("magnitude < 4.3"), seen), plates)
    got = {r.event_id: r for r in out.select("event_id", "mag_type_enc", "count_1d", "elapsed_since_last_s").collect()}
    assert set(got) == {r.event_id for r in targets.collect()}
    assert seen.value == events.where("magnitude < 4.3").count()
    strong = sorted(got)
    near = {i: [j for j in strong if 0 < (i - j) * 5 <= 24] for i in strong}
    assert all(got[i].count_1d == len(near[i]) for i in strong)
    assert all(got[b].elapsed_since_last_s == (b - a) * 5 * 3600.0 for a, b in zip(strong, strong[1:]))
    assert {got[i].mag_type_enc for i in strong if i % 3} == {int(strong[0] % 3 == 0)}


def test_labels_read_their_events_a_few_times(spark):
    """the days of the events are found once, not for every count of a join."""
    seen = spark.sparkContext.accumulator(0)
    events = spark.createDataFrame(rows(200), EVENT)
    forward_labels(counted(events, seen)).agg(F.count("event_id")).collect()
    # days of all events, days of the strong ones, and the events that get the labels
    assert seen.value <= 3 * 200
