"""Window statistics of blocks: no pair is a row, and odd values come out as sums and extremes of rows do."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epicell.constants import DAY_US, RADIUS_KM
from epicell.functions.geo import km_to_chord
from epicell.operators import block_sums as module
from epicell.operators.windows import AT, m4_family, neighborhood_stats

SCHEMA = "event_id long, event_us long, latitude double, longitude double, depth double, magnitude double"


def block(n, seed, span):
    rng = np.random.default_rng(seed)
    angle = rng.uniform(0, 0.06, n)
    return {"us": rng.integers(0, span, n) * DAY_US // 8, "x": np.cos(angle), "y": np.sin(angle), "z": np.zeros(n)}


@pytest.mark.parametrize("matrix, spare", [(1 << 17, 256), (64, 4)])
def test_a_block_against_every_pair(monkeypatch, matrix, spare):
    monkeypatch.setattr(module, "MATRIX", matrix)
    monkeypatch.setattr(module, "SPARE", spare)
    monkeypatch.setattr(module, "UNSURE", 1e-13 if matrix > 64 else 1e-3)
    n = 150
    a, b = block(n, 1, 2000), block(n, 2, 2000)
    rng = np.random.default_rng(5)
    size = [None if rng.random() < 0.2 else float(np.round(rng.uniform(-3, 3), 2)) for _ in range(n)]
    size[3], size[50] = np.inf, -np.inf
    count = [None if v is None else 1 for v in size]
    left = pa.table({"at_lat": np.arange(n, dtype="float64"), "at_us": a["us"], **{f"l_{c}": a[c] for c in "xyz"}})
    right = pa.table({"nb_us": b["us"], "n": pa.array(count, pa.int64()), "s": pa.array(size), "hi": pa.array(size),
                      "lo": pa.array(size), **{f"r_{c}": b[c] for c in "xyz"}})
    whole, real = pa.int64(), pa.float64()
    schema = pa.schema([("at_lat", real), ("at_us", whole), ("window_class", pa.int32()), ("n", whole), ("s", real), ("hi", real), ("lo", real), ("last", whole)])
    limit = km_to_chord(RADIUS_KM) ** 2
    days = [(1, DAY_US), (7, 7 * DAY_US), (90, 90 * DAY_US)]
    run = module.block_sums(limit, ("at_lat", "at_us"), "at_us", "nb_us", days, ["n", "s"], ["hi"], ["lo"], {"last": "n"}, schema)
    got = {(r["at_lat"], r["window_class"]): tuple(r[c] for c in ("n", "s", "hi", "lo", "last")) for r in run(left, right).to_pylist()}
    want = {}
    for i in range(n):
        held = {}
        for j in range(n):
            age = int(a["us"][i] - b["us"][j])
            near = sum((a[c][i] - b[c][j]) ** 2 for c in "xyz") <= limit
            if near and 0 < age <= 90 * DAY_US:
                held.setdefault(next(w for w, length in days if age <= length), []).append(j)
        for w, js in held.items():
            values = [size[j] for j in js if size[j] is not None]
            last = max((int(b["us"][j]) for j in js if size[j] is not None), default=None)
            want[(float(i), w)] = (len(values), sum(values), max(values), min(values), last) if values else (None,) * 5
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, nan_ok=True), key
    assert any(v[0] is None for v in want.values()) and any(v[1] == np.inf for v in want.values())


def test_pairs_are_no_rows_of_the_plan(spark):
    """A join of the rows of both sides, and a second shuffle of what each class of a spot has, cost more with every pair."""
    rows = [(i, i * DAY_US // 4, 45.0 + i % 7 / 10, 7.0, 10.0, 4.5) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    stats = neighborhood_stats(df, df, {"m4": m4_family()})
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join Inner" not in plan
    row = stats.where(F.col(AT[2]) == 40 * DAY_US // 4).first()
    assert (row["m4_n_1"], row["m4_n_7"], row["m4_n_90"], row["m4_last_us"]) == (4, 28, 40, 39 * DAY_US // 4)
