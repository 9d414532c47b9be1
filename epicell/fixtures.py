"""Views over the test tables with the shapes and edge cases of the real inputs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

CATALOG = """
WITH e AS (SELECT event_id, {ts_us} AS us, user_id, event_type, value,
   CASE WHEN user_id < 60 THEN 0 ELSE user_id % 15 END AS cl FROM events)
SELECT event_id, 788918400000000 + (us - 1704067200000000) * 365 AS event_us,
 CAST(((cl*37) % 120 - 60)*1000 + ((event_id*7919) % 1000)*2 - 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS latitude,
 CAST((((cl*73) % 360)*1000 + ((event_id*104729) % 1000)*2 - 1000 + 360000) % 360000 - 180000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS longitude,
 CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST((event_id*31) % 700 AS DOUBLE) END AS depth,
 CASE WHEN value > 350 THEN CAST(9.5 AS DOUBLE) ELSE CAST(floor(value*2 + 250.5e0) AS DOUBLE)/CAST(100 AS DOUBLE) END AS magnitude,
 CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END AS mag_type,
 CASE WHEN event_id % 17 = 0 THEN 'explosion' WHEN event_id % 5 = 0 THEN ' Earthquake ' ELSE 'earthquake' END AS type
FROM e
"""

STATIONS = """
SELECT c_custkey AS station_id,
 CAST((((c_custkey % 10)*37) % 120 - 60)*1000 + ((c_custkey*7919) % 1000)*6 - 3000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS lat,
 CAST(((((c_custkey % 10)*73) % 360)*1000 + ((c_custkey*104729) % 1000)*6 - 3000 + 360000) % 360000 - 180000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS lon,
 CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST((c_custkey*17) % 360 AS DOUBLE) END AS azi,
 CASE c_custkey % 7 WHEN 0 THEN 'NF' WHEN 1 THEN 'TF' WHEN 2 THEN 'SS' WHEN 3 THEN 'NS' WHEN 4 THEN ' TS ' WHEN 5 THEN 'U' ELSE 'XX' END AS regime,
 CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS quality
FROM customer
"""

LINE_VERTICES = """
SELECT s_nationkey AS line_id, s_suppkey AS seq,
 CAST((((s_nationkey % 15)*37) % 120 - 60)*1000 + ((s_suppkey*7919) % 1000)*10 - 5000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS lat,
 CAST(((((s_nationkey % 15)*73) % 360)*1000 + ((s_suppkey*104729) % 1000)*10 - 5000 + 360000) % 360000 - 180000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS lon,
 CASE s_nationkey % 8 WHEN 0 THEN 'normal' WHEN 1 THEN 'Reverse' WHEN 2 THEN ' thrust' WHEN 3 THEN 'STRIKE-SLIP'
   WHEN 4 THEN 'Dextral' WHEN 5 THEN 'oblique' WHEN 6 THEN 'blind thrust' ELSE 'Sinistral-Normal' END AS slip_type
FROM supplier
"""

SCORED = """
SELECT o_orderkey AS prediction_id, 'ev' || CAST(o_custkey AS VARCHAR(20)) AS event_id, {d_us} AS scored_us,
 CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE {d_us} - 86400000000 END AS event_us,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST((o_orderkey*7919) % 500 + CASE WHEN o_orderstatus = 'F' THEN 150 ELSE 0 END AS DOUBLE)/CAST(650 AS DOUBLE) END AS prob_7d,
 CAST((o_orderkey*104729) % 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS prob_30d,
 CASE WHEN o_custkey % 11 = 0 THEN 1 WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label_7d,
 CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS label_30d,
 CASE WHEN o_custkey % 11 = 0 THEN 'm_single' WHEN o_custkey % 13 = 0 THEN NULL ELSE 'm' || CAST(o_custkey % 3 AS VARCHAR(20)) END AS model_version
FROM orders
"""

RUNS = """
SELECT o_orderkey AS run_id, {d_us} AS start_us, CASE WHEN o_orderkey % 9 = 0 THEN 'benchmark_v1' ELSE 'benchmark_v2' END AS benchmark_id,
 CASE o_orderkey % 7 WHEN 0 THEN 'baseline' WHEN 1 THEN 'benchmark_train' WHEN 2 THEN 'best_params_retrain' WHEN 3 THEN 'feature_ablation'
  WHEN 4 THEN 'feature_selection_train' WHEN 5 THEN 'compact_best_params_retrain' ELSE 'optuna_trial' END AS run_kind,
 CASE WHEN o_custkey % 2 = 0 THEN 'label_7d' ELSE 'label_30d' END AS target,
 CASE WHEN o_orderkey % 7 = 3 THEN CASE o_custkey % 3 WHEN 0 THEN 'full_features' WHEN 1 THEN 'no_geo' ELSE 'no_geo_no_background' END ELSE 'default' END AS variant,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST((o_orderkey*31) % 1000 AS DOUBLE)/CAST(1000 AS DOUBLE) END AS test_pr_auc
FROM orders
"""

IMPORTANCE = """
SELECT p_brand AS feature, CASE p_size % 3 WHEN 0 THEN 'label_7d' WHEN 1 THEN 'label_30d' ELSE 'label_365d' END AS target,
 CAST(sum(CAST(p_size AS BIGINT)) AS DOUBLE) AS importance_gain, count(*) AS importance_split
FROM part GROUP BY p_brand, CASE p_size % 3 WHEN 0 THEN 'label_7d' WHEN 1 THEN 'label_30d' ELSE 'label_365d' END
"""

WIDE = """
SELECT l_orderkey, l_linenumber, l_quantity AS count_7d, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS energy_7d,
 l_quantity * 2 AS rate_7d, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS b_value_7d,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS elapsed_since_last_s,
 CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS gap, CAST(NULL AS DOUBLE) AS all_null, 1 AS constant_col,
 CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE 5 END AS not_constant_with_null, l_returnflag AS text_col,
 CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS label_7d
FROM lineitem
"""

VIEWS = {
    "catalog": (CATALOG, "events"),
    "stations": (STATIONS, "customer"),
    "line_vertices": (LINE_VERTICES, "supplier"),
    "scored": (SCORED, "orders"),
    "runs": (RUNS, "orders"),
    "importance": (IMPORTANCE, "part"),
    "wide": (WIDE, "lineitem"),
}

SPARK_TIMES = {
    "ts_us": "unix_micros(CAST(ts AS TIMESTAMP))",
    "d_us": "unix_micros(CAST(o_orderdate AS TIMESTAMP))",
}
DUCKDB_TIMES = {"ts_us": "epoch_us(ts)", "d_us": "epoch_us(o_orderdate)"}


def with_views(*names: str) -> str:
    """The views as the opening WITH clause of a DuckDB statement."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0].format(**DUCKDB_TIMES)})" for n in names)


class Tables:
    """The views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text, table = VIEWS[name]
        # the table arrives as a query argument, so no temporary view is left behind
        return self.spark.sql(
            text.format(**SPARK_TIMES).replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: self.base(table)}
        )

    @cached_property
    def catalog(self) -> DataFrame:
        return self.view("catalog")

    @cached_property
    def stations(self) -> DataFrame:
        return self.view("stations")

    @cached_property
    def line_vertices(self) -> DataFrame:
        return self.view("line_vertices")

    @cached_property
    def scored(self) -> DataFrame:
        return self.view("scored")

    @cached_property
    def runs(self) -> DataFrame:
        return self.view("runs")

    @cached_property
    def importance(self) -> DataFrame:
        return self.view("importance")

    @cached_property
    def wide(self) -> DataFrame:
        return self.view("wide")
