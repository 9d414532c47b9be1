"""Order statistics, distinct counts and correlations in one pass over the rows, against plain ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epicell.operators import audits
from epicell.operators.rank_select import exact_quantiles, from_ordered_bits, ordered_bits, values_at


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_bits_follow_the_order_of_doubles():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-300, 300, 2000), [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]])
    keys = ordered_bits(values)
    assert np.array_equal(np.argsort(keys, kind="stable"), np.argsort(values, kind="stable"))
    assert [from_ordered_bits(int(k)) for k in keys] == values.tolist()
    assert ordered_bits(np.array([-0.0])) == ordered_bits(np.array([0.0]))


def test_ranks_equal_sorted_values(spark):
    rng = np.random.default_rng(2)
    data = {"narrow": 1.7e15 + rng.integers(0, 90, 3000) * 1.0, "wide": rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000), "ties": rng.integers(-3, 3, 3000) * 0.5}
    frame = pd.DataFrame(data)
    frame.loc[::7, "wide"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "narrow double, wide double, ties double").repartition(6)
    wanted = [(c, r) for c in data for r in (0, 1, 700, 1499, 2500)]
    ordered = {c: sorted(v for v in frame[c] if not math.isnan(v)) for c in data}
    assert values_at(df, wanted) == [ordered[c][r] for c, r in wanted]
    probs = {"narrow": 0.5, "wide": 0.99, "ties": 0.25}
    got = exact_quantiles(df.withColumn("none", F.lit(None).cast("double")), probs | {"none": 0.5})
    assert got == pytest.approx({c: float(np.quantile(ordered[c], p)) for c, p in probs.items()}, rel=1e-12)


def test_distinct_values_in_one_pass(spark, monkeypatch):
    rows = [(float(i % 5) if i % 11 else None, None, "xy"[i % 2], i, bytes([i % 3]), -0.0 if i % 2 else 0.0, [i % 4]) for i in range(500)]
    schema = "a double, b string, c string, d long, e binary, f double, g array<int>"
    df = spark.createDataFrame(rows, schema).repartition(4)
    want = {"a": 6, "b": 1, "c": 2, "d": 500, "e": 3, "f": 1, "g": 4}
    found = audits.column_cardinality(df)
    assert {r.column: r.n_distinct for r in found.collect()} == want and "Expand" not in plan_of(found)
    assert {r.column for r in found.where("is_constant").collect()} == {"b", "f"}
    monkeypatch.setattr(audits, "HELD_VALUES", 10)
    assert {r.column: r.n_distinct for r in audits.column_cardinality(df).collect()} == want
    assert {r.n_distinct for r in audits.column_cardinality(df.limit(0)).collect()} == {0}


def test_sketches_are_near_and_can_be_merged(spark):
    df = spark.range(40_000).selectExpr("id % 10000 AS many", "IF(id % 3 = 0, NULL, id % 7) AS few")
    near = {r.column: r.n_distinct for r in audits.column_cardinality(df, approximate=True).collect()}
    assert near["few"] == 8 and abs(near["many"] - 10_000) < 300
    parts = audits.cardinality_sketches(df.where("many < 6000")).unionByName(audits.cardinality_sketches(df.where("many >= 4000")))
    merged = parts.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    assert abs({r.column: r.n for r in merged.collect()}["many"] - 10_000) < 300


def test_correlations_equal_pandas(spark):
    rng = np.random.default_rng(5)
    n = 2000
    base = rng.normal(size=n)
    frame = pd.DataFrame({"a": base + 1e9, "b": -2e-6 * base + 1e-7 * rng.normal(size=n), "c": base + rng.normal(size=n), "d": np.full(n, 3.3), "e": rng.normal(size=n) * 1e30})
    frame.loc[::3, "b"] = None
    frame.loc[1::4, "c"] = None
    frame.loc[frame.index % 3 != 0, "d"] = 4.4  # constant where b is there
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame)).repartition(5)
    found = audits.high_corr_pairs(df, list(frame), thr=0.0)
    plan = plan_of(found)
    assert "Generate" not in plan and "Expand" not in plan
    got = {(r.a, r.b): r.abs_corr for r in found.collect()}
    want = frame.corr().abs()
    assert ("b", "d") not in got and len(got) == 9
    assert all(v == pytest.approx(want.loc[a, b], abs=1e-7) for (a, b), v in got.items())
    assert [r.a for r in audits.high_corr_pairs(df, list(frame), thr=0.9).collect()] == ["a"]
    assert audits.high_corr_pairs(df, ["a"]).count() == 0
