"""The grid joins against brute force on hard points."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epicell.constants import DAY_US, EARTH_KM
from epicell.operators import neighbors
from epicell.operators.background import radius_count
from epicell.operators.followups import elapsed_since_last, followup_exists, forward_labels
from epicell.operators.neighbors import TimeSpan, near_pairs, radius_join, window_neighbors
from epicell.operators.windows import window_features

SCHEMA = "event_id long, event_us long, latitude double, longitude double, depth double, magnitude double"


def km(a, b):
    la1, lo1, la2, lo2 = np.radians(a[:, None, 0]), np.radians(a[:, None, 1]), np.radians(b[None, :, 0]), np.radians(b[None, :, 1])
    h = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo2 - lo1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))


def hard_points(n=300, seed=7):
    """Poles, the antimeridian, the equator, copies and a scatter over the globe."""
    rng = np.random.default_rng(seed)
    parts = [
        np.column_stack([rng.uniform(86, 90, n), rng.uniform(-180, 180, n)]),
        np.column_stack([rng.uniform(-90, -87, n), rng.uniform(-180, 180, n)]),
        np.column_stack([rng.uniform(-2, 2, n), np.where(rng.random(n) < 0.5, 180 - rng.random(n) * 2, -180 + rng.random(n) * 2)]),
        np.column_stack([rng.uniform(48, 52, n), rng.uniform(-1, 4, n)]),
        np.column_stack([np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)]),
        np.array([[90.0, 0.0], [90.0, 77.0], [-90.0, 180.0], [0.0, 180.0], [0.0, -180.0], [50.0, 1.0], [50.0, 1.0]]),
    ]
    return np.round(np.vstack(parts), 4)


def catalog_frame(spark, points, seed=3, days=400):
    rng = np.random.default_rng(seed)
    n = len(points)
    pdf = pd.DataFrame(
        {
            "event_id": np.arange(n),
            "event_us": rng.integers(0, days * DAY_US, n),
            "latitude": points[:, 0],
            "longitude": points[:, 1],
            "depth": rng.uniform(0, 600, n),
            "magnitude": np.round(rng.uniform(2.5, 7, n), 2),
        }
    )
    return pdf, spark.createDataFrame(pdf, SCHEMA)


@pytest.fixture(scope="module")
def world(spark):
    points = hard_points()
    pdf, df = catalog_frame(spark, points)
    return pdf, df.cache(), km(points, points)


@pytest.mark.parametrize("radius", [1.0, 200.0, 1500.0])
def test_radius_join_is_exact(world, radius):
    pdf, df, dist = world
    got = {(r.left_id, r.right_id) for r in radius_join(df, df, radius).collect()}
    assert got == set(zip(*np.where(dist <= radius)))


@pytest.mark.parametrize("rows", [7, neighbors.BLOCK_ROWS])
def test_cutting_hot_blocks_changes_nothing(world, rows, monkeypatch):
    pdf, df, dist = world
    monkeypatch.setattr(neighbors, "cut_hot_blocks", lambda a, b, k, **more: _cut_original(a, b, k, block_rows=rows, **more))
    a = df.select(F.col("event_id").alias("a"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"), F.col("event_us").alias("ta"))
    b = df.select(F.col("event_id").alias("b"), F.col("latitude").alias("lb"), F.col("longitude").alias("lp"), F.col("event_us").alias("tb"))
    span = TimeSpan("ta", "tb", -30 * DAY_US, 30 * DAY_US)
    got = [(r.a, r.b) for r in near_pairs(a, b, ("la", "lo"), ("lb", "lp"), 400.0, span).select("a", "b").collect()]
    t = pdf.event_us.to_numpy()
    want = np.where((dist <= 400.0) & (np.abs(t[:, None] - t[None, :]) <= 30 * DAY_US))
    assert len(got) == len(set(got))
    assert set(got) == set(zip(*want))


_cut_original = neighbors.cut_hot_blocks


def test_half_of_the_rows_in_one_cell_are_many_tiles(spark):
    df = spark.range(4000).selectExpr("id as a", "if(id % 2 = 0, 1, id) as cell")
    left, right, keys = neighbors.cut_hot_blocks(df, df.withColumnRenamed("a", "b"), ["cell"], block_rows=100)
    rows = left.groupBy(*keys).count().join(right.groupBy(*keys).count().withColumnRenamed("count", "n"), keys)
    largest = rows.selectExpr("max(count * n) as m", "sum(count * n) as total").first()
    assert largest.total == 2001 * 2001 + 1999 and largest.m < 4 * 100 * 100


def test_window_is_closed_below_and_open_above(spark):
    w = 90 * DAY_US
    rows = [(0, 10 * w, 0.0, 0.0, 1.0, 5.0), (1, 9 * w, 0.0, 0.0, 1.0, 5.0), (2, 9 * w - 1, 0.0, 0.0, 1.0, 5.0), (3, 10 * w, 0.0, 0.0, 1.0, 5.0), (4, 10 * w - 1, 0.0, 0.0, 1.0, 3.9)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.event_id, r.neighbor_id) for r in window_neighbors(df.where("magnitude >= 4"), df, 90).collect()}
    assert got == {(0, 1), (3, 1), (1, 2)}


def test_radius_count_is_exact(world):
    pdf, df, dist = world
    ref = df.where("magnitude >= 4")
    got = {r.event_id: r.n_near for r in radius_count(df, ref).collect()}
    want = (dist[:, pdf.magnitude.to_numpy() >= 4] <= 200).sum(axis=1)
    assert got == dict(enumerate(want))


def test_labels_on_day_granularity(spark):
    d = DAY_US
    rows = [
        (0, 100 * d + 5, 10.0, 20.0, 1.0, 4.0),
        (1, 100 * d + 900, 10.0, 20.1, 1.0, 6.0),  # same day: does not count for 0
        (2, 465 * d + 1, 10.0, 20.0, 1.0, 5.0),  # exactly 365 days after day 100
        (3, 831 * d, 10.0, 20.0, 1.0, 5.0),  # 366 days after 2
        (4, 833 * d, 50.0, 20.0, 1.0, 9.0),  # far away
        (5, 838 * d, 10.0, 20.0, 1.0, 5.0),  # exactly 7 days after 3
    ]
    got = {r.event_id: (r.label_7d, r.label_30d, r.label_365d) for r in forward_labels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: (0, 0, 1), 1: (0, 0, 1), 2: (0, 0, 0), 3: (1, 1, 1), 4: (0, 0, 0), 5: (0, 0, 0)}


def test_followups_on_second_granularity(spark):
    s = 1_000_000
    rows = [(0, 50 * s + 3, 0.0, 0.0, 1.0, 4.0), (1, 51 * s - 1, 0.0, 0.0, 1.0, 6.0), (2, 50 * s + 7 * DAY_US, 1.0, 0.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.event_id: r.has_followup for r in followup_exists(df, df, 7).collect()}
    assert got == {0: True, 1: True, 2: False}
    only_early = followup_exists(df, df.where("event_id = 1"), 7)
    assert {r.event_id: r.has_followup for r in only_early.collect()} == {0: False, 1: False, 2: False}


def test_elapsed_widens_until_found(world):
    pdf, df, dist = world
    t, big = pdf.event_us.to_numpy(), pdf.magnitude.to_numpy() >= 4
    got = {r.event_id: r.elapsed_since_last_s for r in elapsed_since_last(df, df, passes=(20, 60)).collect()}
    for i in range(len(pdf)):
        earlier = t[(dist[i] <= 200) & big & (t < t[i])]
        want = (t[i] - earlier.max()) / 1e6 if len(earlier) else None
        assert got[i] == (pytest.approx(want) if want is not None else None)


def test_copies_do_not_meet_but_count(spark):
    """A third of the rows are copies of one event; a later event sees all of them."""
    copies = [(i, 1000, 5.0, 5.0, 10.0, 4.5) for i in range(50)]
    later = [(100, 1001, 5.0, 5.1, 10.0, 6.0)]
    df = spark.createDataFrame(copies + later, SCHEMA)
    got = {r.event_id: r for r in window_features(df, df).collect()}
    assert got[100].count_1d == 50 and got[100].mag_std_1d == 0.0 and got[100].b_value_1d is None
    assert got[0].count_90d == 0 and got[0].energy_90d == 0.0 and got[0].mag_max_90d is None
    assert math.isclose(got[100].energy_1d, 50 * 10 ** (1.5 * 4.5))


def test_window_statistics_policies(spark):
    rows = [(0, 100 * DAY_US, 0.0, 0.0, None, 6.0)] + [(i, 99 * DAY_US + i, 0.0, 0.0, d, m) for i, (d, m) in enumerate([(None, 4.0), (10.0, 4.4), (30.0, 4.2), (None, 5.0), (20.0, 4.1)], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    row = window_features(df.where("event_id = 0"), df).first()
    mags = np.array([4.0, 4.4, 4.2, 5.0, 4.1])
    assert row.count_1d == 5 and row.rate_7d == pytest.approx(5 / 7)
    assert row.mag_std_1d == pytest.approx(mags.std()) and row.b_value_1d == pytest.approx(math.log10(math.e) / (mags.mean() - 4.0))
    assert row.depth_mean_1d == pytest.approx(20.0) and row.depth_std_1d == pytest.approx(np.std([10, 30, 20]))
    assert row.moment_1d == pytest.approx((10 ** (1.5 * mags + 9.1)).sum())


def test_labels_equal_brute_force(world):
    pdf, df, dist = world
    day, big = pdf.event_us.to_numpy() // DAY_US, pdf.magnitude.to_numpy() >= 5
    got = {r.event_id: (r.label_7d, r.label_30d, r.label_365d) for r in forward_labels(df).collect()}
    for i in range(len(pdf)):
        gap = (day - day[i])[(dist[i] <= 200) & big]
        assert got[i] == tuple(int(((gap > 0) & (gap <= h)).any()) for h in (7, 30, 365))


def test_bounds_of_blocks_hold(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([-89.9, 0.0, rng.uniform(-90, 90)]), rng.choice([179.9, rng.uniform(-180, 180)]), rng.randrange(-500, 500)) for i in range(400)]
    left = spark.createDataFrame(rows, "id long, lat double, lon double, t long")
    for km, span in ((200.0, neighbors.TimeSpan("t", "u", -30, 0, True)), (900.0, neighbors.TimeSpan("t", "u", 1, 30)), (50.0, None)):
        real = neighbors.explode_cover(left, "lat", "lon", km, 2.0)
        keys = ["cell"]
        if span is not None:
            real, keys = real.withColumn("bucket", F.explode(span.left_buckets())), ["cell", "bucket"]
        bound = neighbors.rows_at_most(left, ("lat", "lon"), km, span, 2.0)
        both = real.groupBy(*keys).count().join(bound, keys, "left")
        assert both.where("rows IS NULL OR rows < count").count() == 0


def test_repeated_side_is_shuffled_without_vectors(spark):
    """F16: what is repeated for cells and buckets goes over the wire with its place only; its vector is made where it arrives."""
    from epicell.operators.neighbors import window_neighbors

    rows = [(k, k * 3_600_000_000, 10.0 + k / 50, 20.0, 4.5) for k in range(30)]
    events = spark.createDataFrame(rows, "event_id long, event_us long, latitude double, longitude double, magnitude double")
    pairs = window_neighbors(events, events, 1)
    above, below = pairs._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)
    assert "AS l_x" in above and "AS l_x" not in below
    assert pairs.count() == sum(1 for a in range(30) for b in range(30) if 0 < a - b <= 24 and (a - b) / 50 * 111.195 <= 200)


def test_pairs_of_one_cell_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PAIR_BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbors, "LIST_ROWS", 8)
    # 300 places of one cell, one event there 100 times over, one without a place
    at = [(i, 10.0 + i / 1000, 20.0 + (i * 7 % 300) / 1000) for i in range(300)] + [(5, 10.5, 20.5)] * 100
    df = spark.createDataFrame([*at, (900, None, 20.0)], "event_id long, latitude double, longitude double")
    pairs = radius_join(df, df).withColumn("task", F.spark_partition_id())
    got = pairs.groupBy("left_id", "right_id", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("distance_km").alias("km")).toPandas()
    assert got["n"].sum() == 400 * 400 and got["task"].nunique() > 8
    ids, places = np.array([a[0] for a in at]), np.array([a[1:] for a in at])
    far = pd.DataFrame(km(places, places), index=ids, columns=ids).stack().reset_index()
    far.columns = ["left_id", "right_id", "km"]
    want = far.groupby(["left_id", "right_id"])["km"].agg(["size", "sum"])
    seen = got.groupby(["left_id", "right_id"])[["n", "km"]].sum()
    assert (seen["n"] == want["size"]).all() and np.allclose(seen["km"], want["sum"], atol=1e-8, rtol=0)
    rows = df.where("event_id < 900").groupBy(*df.columns).count().select("*", F.explode(F.sequence(F.lit(1), "count")).alias("copy"))
    lists = neighbors.in_lists(rows.withColumn("cell", F.lit(1)), ["cell"])
    assert lists.agg(F.max(F.size("near"))).first()[0] <= 30


def test_left_rows_are_repeated_only_for_cells_with_right_rows(spark):
    """A disc meets several cells; the one right row, beside a row without a place, lies in one of them."""
    left = spark.createDataFrame([(i, 45.0 + i / 100, 7.0) for i in range(20)], "a long, la double, lo double")
    right = spark.createDataFrame([(1, 45.5, 7.5), (2, None, 7.5)], "b long, lb double, lp double")
    l_keyed, _, _ = neighbors.in_blocks(left, right, ("la", "lo"), ("lb", "lp"), 200.0, None)
    assert sorted(r.a for r in l_keyed.collect()) == list(range(20))
    pairs = near_pairs(left, right, ("la", "lo"), ("lb", "lp"), 200.0).select("a", "b").collect()
    assert sorted((r.a, r.b) for r in pairs) == [(i, 1) for i in range(20)]
