"""Nearest-object search against brute force."""

import numpy as np
import pandas as pd
import pytest

from epicell.constants import MERCATOR_M
from epicell.operators.lines import polyline_segments
from epicell.operators.nearest import nearest_centroid_attr, nearest_line_km, nearest_station, nearest_vertex_km
from tests.test_neighbors import hard_points, km


@pytest.fixture(scope="module")
def events(spark):
    points = hard_points(60, seed=11)
    pdf = pd.DataFrame({"event_id": np.arange(len(points)), "latitude": points[:, 0], "longitude": points[:, 1]})
    return points, spark.createDataFrame(pdf)


@pytest.mark.parametrize("n,spread", [(1, 1.0), (5, 80.0), (400, 85.0), (200, 3.0)])
def test_vertices_anywhere(spark, events, n, spread):
    """One object for the globe, a handful, many, and all of them in one corner."""
    points, df = events
    rng = np.random.default_rng(n)
    v = np.column_stack([rng.uniform(-spread, spread, n), rng.uniform(-2.1, 2.1, n) * spread])
    vertices = spark.createDataFrame(pd.DataFrame(v, columns=["lat", "lon"]))
    got = nearest_vertex_km(df, vertices, "d").orderBy("event_id").toPandas().d.to_numpy()
    assert np.allclose(got, km(points, v).min(axis=1), atol=1e-6)


def test_station_rules(spark, events):
    points, df = events
    rows = [(1, 50.0, 1.0, 90.0, "NF", "A"), (2, 50.0, 1.0, 10.0, "SS", "B"), (3, 0.0, 179.9, 0.0, " TS ", "C"), (4, 51.0, 2.0, None, "TF", "A"), (5, 51.0, 2.0, 5.0, "TF", "D")]
    stations = spark.createDataFrame(rows, "station_id int, lat double, lon double, azi double, regime string, quality string")
    used = np.array([[50.0, 1.0], [0.0, 179.9]])
    dist = km(points, used)
    got = nearest_station(df, stations).orderBy("event_id").collect()
    for i, row in enumerate(got):
        d, which = dist[i].min(), dist[i].argmin()
        assert row.wsm_dist_km == pytest.approx(d, abs=1e-6)
        if d > 500:
            assert (row.stress_regime_enc, row.wsm_quality_enc, row.shmax_sin, row.shmax_cos) == (4, 0, 0.0, 0.0)
        else:
            # two stations share a place: the smaller id wins
            assert (row.stress_regime_enc, row.wsm_quality_enc) == ((0, 4) if which == 0 else (3, 2))


def plane(p):
    lat = np.radians(np.clip(p[:, 0], -89.9, 89.9))
    return np.column_stack([np.radians(p[:, 1]), np.log(np.tan(np.pi / 4 + lat / 2))]) * MERCATOR_M


@pytest.mark.parametrize("jump", [2.0, 120.0])
def test_lines_short_and_across_the_map(spark, events, jump):
    points, _ = events
    points = points[np.abs(points[:, 0]) < 89.9]
    df = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(len(points)), "latitude": points[:, 0], "longitude": points[:, 1]}))
    rng = np.random.default_rng(int(jump))
    lines = []
    for line in range(12):
        at = np.array([rng.uniform(-70, 70), rng.uniform(-170, 170)])
        for seq in range(1 if line == 0 else 4):
            lines.append((line, seq, float(at[0]), float(at[1]), "Normal" if line % 2 else "oblique"))
            at = np.clip(at + rng.uniform(-jump, jump, 2), [-80, -179], [80, 179])
    vertices = spark.createDataFrame(lines, "line_id int, seq int, lat double, lon double, slip_type string")
    segments = polyline_segments(vertices).cache()
    s = segments.orderBy("line_id", "seq").toPandas()
    a, b, p = plane(s[["lat_a", "lon_a"]].to_numpy()), plane(s[["lat_b", "lon_b"]].to_numpy()), plane(points)
    ab, ap = (b - a)[None], p[:, None] - a[None]
    ll = (ab**2).sum(-1)
    t = np.clip(np.where(ll > 0, (ap * ab).sum(-1) / np.where(ll > 0, ll, 1), 0), 0, 1)
    want = np.sqrt(((ap - t[..., None] * ab) ** 2).sum(-1)).min(axis=1) / 1000
    got = nearest_line_km(df, segments, "d").orderBy("event_id").toPandas().d.to_numpy()
    assert np.allclose(got, want, rtol=1e-9, atol=1e-6)

    length = np.sqrt(((b - a) ** 2).sum(-1))
    s["x"], s["y"], s["len"] = (a[:, 0] + b[:, 0]) / 2, (a[:, 1] + b[:, 1]) / 2, length
    cent = {k: (np.average(g[["x", "y"]], axis=0, weights=g.len) if g.len.sum() > 0 else g[["x", "y"]].mean().to_numpy()) for k, g in s.groupby("line_id")}
    ids = np.array(list(cent))
    near = ids[np.sqrt(((p[:, None] - np.array(list(cent.values()))[None]) ** 2).sum(-1)).argmin(axis=1)]
    types = vertices.select("line_id", "slip_type").distinct()
    codes = nearest_centroid_attr(df, segments, types).orderBy("event_id").toPandas().fault_slip_type_enc.to_numpy()
    assert (codes == np.where(near % 2, 1, 4)).all()


def test_single_vertex_line_is_a_point(spark):
    vertices = spark.createDataFrame([(1, 9, 5.0, 6.0)], "line_id int, seq int, lat double, lon double")
    row = polyline_segments(vertices).first()
    assert (row.lat_a, row.lon_a, row.lat_b, row.lon_b) == (5.0, 6.0, 5.0, 6.0)
    event = spark.createDataFrame([(1, 5.0, 6.0)], "event_id int, latitude double, longitude double")
    assert nearest_line_km(event, polyline_segments(vertices)).first().dist_km == pytest.approx(0.0, abs=1e-6)


def test_empty_layers_keep_all_events(spark):
    from epicell.operators.nearest import coastal_flag, nearest_centroid_attr, nearest_line_km, nearest_station, nearest_vertex_km

    events = spark.createDataFrame([(1, 10.0, 20.0), (2, -90.0, 0.0), (3, 5.0, 179.9)], "event_id long, latitude double, longitude double")
    stations = spark.createDataFrame([], "station_id long, lat double, lon double, azi double, regime string, quality string")
    got = nearest_station(events, stations).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == [(i, 4, 0.0, 0.0, 0, None) for i in (1, 2, 3)]
    vertices = spark.createDataFrame([], "lat double, lon double")
    segments = spark.createDataFrame([], "line_id long, lat_a double, lon_a double, lat_b double, lon_b double")
    types = spark.createDataFrame([], "line_id long, slip_type string")
    assert {r[1] for r in nearest_vertex_km(events, vertices).collect()} == {None}
    assert {r[1] for r in coastal_flag(events, vertices).collect()} == {0}
    assert nearest_line_km(events, segments).count() == 3
    assert {r[1] for r in nearest_centroid_attr(events, segments, types).collect()} == {0}
    one = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "line_id long, lat_a double, lon_a double, lat_b double, lon_b double")
    assert nearest_line_km(events, one).count() == 3


def test_pairs_are_not_sorted_by_event(spark, monkeypatch):
    """F9 to F11: the memory of a task follows its events; an event meets its candidates as lists, of any number, and equal keys stay one row."""
    from epicell.operators import nearest

    monkeypatch.setattr(nearest, "LIST_ROWS", 7)
    rng = np.random.default_rng(5)
    v = np.column_stack([rng.uniform(10.0, 10.2, 300), rng.uniform(20.0, 20.2, 300)])
    points = np.column_stack([rng.uniform(10.0, 10.2, 40), rng.uniform(20.0, 20.2, 40)])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(0, float(points[1, 0]), float(points[1, 1])), (2, None, None)]
    df = spark.createDataFrame(rows, "event_id long, latitude double, longitude double")
    vertices = spark.createDataFrame(pd.DataFrame(v, columns=["lat", "lon"]))
    plan_of = nearest_vertex_km(df, vertices, "d")
    plan = plan_of._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "array_min" in plan
    got = {r.event_id: r.d for r in plan_of.collect()}
    want = km(points, v).min(axis=1)
    want[0] = min(want[0], want[1])
    assert len(got) == 40 and got[2] is None  # a row without a place leaves its key open
    assert all(abs(got[i] - want[i]) < 1e-6 for i in range(40) if i != 2)
