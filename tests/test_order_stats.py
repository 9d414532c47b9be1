"""Running totals over values of any size, in ranges that stay small."""

import numpy as np
from pyspark.sql import functions as F

from epicell.operators.order_stats import RANGE_BITS, running_below, value_key


def test_keys_follow_the_order_of_doubles(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([
        rng.normal(size=3000) * 10.0 ** rng.integers(-320, 300, 3000),
        2.0 ** np.arange(-1074, 1023), np.nextafter(2.0 ** np.arange(-1000, 1000), 0), -(2.0 ** np.arange(-500, 500)),
        [0.0, -0.0, 5e-324, 1.7976931348623157e308, 0.1, 1.0, 2.0],
    ])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", value_key(F.col("v")).alias("k")).orderBy("v").collect()
    keys = [r.k for r in df]
    assert keys == sorted(keys)


def test_many_tiny_scores_fall_into_many_ranges(spark):
    df = spark.range(200_000).selectExpr("(id + 1) * 1e-6 / 200000 as v")
    finest = df.groupBy(F.shiftright(value_key(F.col("v")), RANGE_BITS[-1])).count().agg(F.max("count")).first()[0]
    middle = df.groupBy(F.shiftright(value_key(F.col("v")), RANGE_BITS[0])).count().agg(F.max("count")).first()[0]
    assert finest == 1 and middle < 2_000


def test_times_in_a_narrow_band(spark):
    df = spark.range(100_000).selectExpr("cast(1700000000000000 + id * 1000000 as double) as v")
    assert df.groupBy(F.shiftright(value_key(F.col("v")), RANGE_BITS[-1])).count().agg(F.max("count")).first()[0] < 10


def test_totals_equal_a_plain_sum(spark):
    rng = np.random.default_rng(2)
    values = sorted({float(v) for v in rng.normal(size=500) * 10.0 ** rng.integers(-12, 12, 500)} | {0.0})
    rows = [(g, v, i % 5 + 1) for g in "ab" for i, v in enumerate(values)]
    got = {(r.g, r.v): r.n_below for r in running_below(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", ["n"]).collect()}
    below = np.concatenate([[0], np.cumsum([i % 5 + 1 for i in range(len(values))])])
    assert got == {(g, v): int(below[i]) for g in "ab" for i, v in enumerate(values)}
