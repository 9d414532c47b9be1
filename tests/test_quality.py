"""Metrics and order statistics against closed forms."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from epicell.operators.audits import freshness_alerts, high_corr_pairs
from epicell.operators.impute import impute_by_prefix
from epicell.operators.order_stats import exact_percentiles, running_below
from epicell.operators.quality import ranking_metrics, threshold_sweep_f2


def by_hand(s, y):
    pos, neg = s[y == 1], s[y == 0]
    auc = (np.sign(pos[:, None] - neg[None, :]) + 1).mean() / 2
    ap, last = 0.0, 0.0
    for v in sorted(set(s), reverse=True):
        tp, n = (y[s >= v]).sum(), (s >= v).sum()
        recall = tp / y.sum()
        ap, last = ap + (recall - last) * tp / n, recall
    return auc, ap


def test_areas_with_ties(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 12, 500) / 12, rng.integers(0, 2, 500)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    row = ranking_metrics(df, "s", "y").first()
    auc, ap = by_hand(s, y)
    assert row.roc_auc == pytest.approx(auc) and row.pr_auc == pytest.approx(ap)
    assert row.brier_score == pytest.approx(((s - y) ** 2).mean()) and row.sample_size == 500
    turned = ranking_metrics(df.withColumn("s", 1 - F.col("s")), "s", "y").first()
    assert turned.roc_auc == pytest.approx(1 - auc)


def test_one_class_keeps_the_rest(spark):
    df = spark.createDataFrame([(0.2, 1, "a"), (0.4, 1, "a"), (0.3, 0, "b"), (0.5, 1, "b"), (None, 1, "a")], "s double, y int, g string")
    got = {r.g: r for r in ranking_metrics(df, "s", "y", ["g"]).collect()}
    assert got["a"].roc_auc is None and got["a"].pr_auc is None and got["a"].sample_size == 2 and got["a"].positive_rate == 1.0
    assert got["b"].roc_auc == 1.0 and got["b"].pr_auc == 1.0


def test_sweep_without_positives_keeps_the_start(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0)], "s double, y int")
    row = threshold_sweep_f2(df, "s", "y").first()
    assert (row.threshold, row.f2) == (0.5, 0.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e15, 1e15, allow_nan=False) | st.sampled_from([0.0, -1.0, 1e-300, 5.5]), min_size=1, max_size=60))
def test_running_totals_and_percentiles(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"v": values}), "v double")
    counted = df.groupBy((F.col("v") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: r.n_below for r in running_below(counted, [], "v", ["n"]).collect()}
    arr = np.array(values)
    assert all(got[v] == (arr < v).sum() for v in got)
    for p in (0.5, 0.99):
        value = exact_percentiles(df, {"v": p}).first().percentile
        assert value == pytest.approx(np.quantile(arr, p), rel=1e-9, abs=1e-9)


def test_impute_rules(spark):
    rows = [(1.0, None, 10.0, 1.0, None), (None, 2.0, None, None, 3.0), (3.0, 4.0, 30.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "count_7d double, b_value_7d double, elapsed_since_last_s double, gap double, label_7d double")
    out = impute_by_prefix(df).toPandas()
    assert out.count_7d.tolist() == [1.0, 0.0, 3.0] and out.b_value_7d.tolist() == [1.0, 2.0, 4.0]
    assert out.elapsed_since_last_s[1] == pytest.approx(10 * np.quantile([10, 30], 0.99)) and out.gap[1] == 3.0
    assert out.label_7d.isna().sum() == 1


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 0.1, -float(i)) for i in range(20)], "a double, b double, c double, d double")
    assert {(r.a, r.b) for r in high_corr_pairs(df).collect()} == {("a", "b"), ("a", "d"), ("b", "d")}


def test_alert_limits(spark):
    m = 60_000_000
    runs = [("scoring_pipeline", 0, True), ("scoring_pipeline", 10 * m, False), ("outcomes_pipeline", 0, True)]
    df = spark.createDataFrame(runs, "pipeline_name string, finished_us long, success boolean")
    got = {r.pipeline_name: r for r in freshness_alerts(df, 100 * m).collect()}
    assert not got["scoring_pipeline"].stale and got["scoring_pipeline"].failed and not got["outcomes_pipeline"].stale
    assert {r.pipeline_name: r.stale for r in freshness_alerts(df, 101 * m).collect()}["scoring_pipeline"]
