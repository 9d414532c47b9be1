"""The public contract, keyed tables, cleaning rules, readers' errors, plans."""

import pytest
from pyspark.sql import functions as F

import checks
from epicell.fixtures import Tables
from epicell.operators import cleaning, serving
from epicell.operators.windows import window_features
from epicell.session import shared_dir, size_shuffles
from epicell.sources.catalogs import read_catalog_any
from epicell.sources.geojson import parse_geojson_events
from epicell.sources.keyed import KeyedTable
from epicell.sources.tables import Snapshots, serving_metadata

PUBLIC_KEYS = set(
    "event_id event_us latitude longitude depth magnitude prob_7d prob_30d prob_365d risk_7d risk_30d risk_365d"
    " risk_7d_code risk_30d_code risk_365d_code scored_us model_version benchmark_id feature_set_version dataset_version".split()
)


def contract_row(**changes):
    row = dict(
        event_id="us6000test1", event_us=1775898604765000, latitude=39.9153, longitude=141.5227, depth=79.374, magnitude=4.3,
        prob_7d=0.443, prob_30d=0.6169, prob_365d=0.9919, risk_7d="🟡 Modéré", risk_30d="🟠 Élevé", risk_365d="🔴 Très élevé",
        scored_us=1775901012636086, model_version="m", benchmark_id="benchmark_v2", feature_set_version="f", dataset_version="d",
        mlflow_run_id="secret",
    )
    return row | changes


CONTRACT_SCHEMA = (
    "event_id string, event_us long, latitude double, longitude double, depth double, magnitude double, prob_7d double, prob_30d double,"
    " prob_365d double, risk_7d string, risk_30d string, risk_365d string, scored_us long, model_version string, benchmark_id string,"
    " feature_set_version string, dataset_version string, mlflow_run_id string"
)


def frame(spark, *rows):
    names = [c.split()[0] for c in CONTRACT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], CONTRACT_SCHEMA)


def test_feed_contract(spark):
    feed = serving.scored_feed(frame(spark, contract_row()), 50)
    assert set(feed.columns) == PUBLIC_KEYS | {"valid"}
    row = feed.first()
    assert (row.risk_7d_code, row.risk_30d_code, row.risk_365d_code) == ("moderate", "high", "very_high")
    assert serving.feed_meta(feed).first().asDict() == {"count": 1, "limit": 50, "rejected": 0}


def test_invalid_row_is_rejected_and_counted(spark):
    rows = serving.public_rows(frame(spark, contract_row(), contract_row(event_id=None)))
    assert serving.feed_meta(rows).first().asDict() == {"count": 1, "limit": 50, "rejected": 1}


def test_limit_comes_before_validation(spark):
    rows = [contract_row(event_id=f"e{i}", scored_us=i, depth=None if i > 7 else 1.0) for i in range(10)]
    meta = serving.feed_meta(serving.scored_feed(frame(spark, *rows), 3)).first()
    assert (meta["count"], meta["rejected"]) == (1, 2)
    with pytest.raises(ValueError):
        serving.scored_feed(frame(spark, *rows), 201)


def test_detail_and_not_found(spark):
    df = frame(spark, contract_row())
    assert set(serving.lookup_event(df, "us6000test1").columns) == PUBLIC_KEYS
    assert serving.lookup_event(df, "unknown-event").count() == 0


def test_horizon_is_checked(spark):
    with pytest.raises(ValueError):
        serving.eval_history(spark.createDataFrame([("7d", 1)], "horizon string, evaluated_us long"), "365d")


def test_metadata_from_environment(monkeypatch):
    monkeypatch.setenv("SERVING_MODEL_VERSION", "other")
    meta = serving_metadata()
    assert meta["model_version"] == "other" and meta["benchmark_id"] == "benchmark_v2" and len(meta) == 5


def test_keyed_table_keeps_last_write(spark):
    table = KeyedTable(spark, shared_dir(spark, "keyed"), "k", buckets=3)
    schema = "k string, v int, at long"
    table.merge(spark.createDataFrame([(f"a{i}", i, 1) for i in range(20)], schema), ["at"])
    table.merge(spark.createDataFrame([("a3", 100, 2), ("a4", 100, 0), ("new", 7, 5), ("new", 8, 4)], schema), ["at"])
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 21 and got["a3"] == 100 and got["a4"] == 4 and got["new"] == 7 and got["a19"] == 19


def test_unfinished_snapshot_is_not_read(spark):
    table = Snapshots(spark, shared_dir(spark, "snap"))
    assert table.read() is None
    table.write(spark.range(3), 0)
    # a job that died leaves files without the commit marker
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{table.path}/v=1")
    assert table.numbers() == [0] and table.read().count() == 3
    table.write(spark.range(5), 1)
    assert table.read().count() == 5 and table.read(below=1).count() == 3


def test_cleaning_order_and_manifest(spark):
    rows = [("2020-01-01", 1.0, None, 5.0, "x", 1, 0.5), ("bad", 2.0, None, 5.0, "y", 1, None), ("2021-01-01T00:00:00Z", 3.0, None, 5.0, "z", 1, 0.5)]
    df = spark.createDataFrame(rows, "datetime string, a double, gone double, same double, text string, label_7d int, almost double")
    out, manifest = cleaning.apply_cleaning_rules(df.withColumn("rate_1d", F.col("a")), cleaning.CLEANING_RULES_V2)
    # the constant target goes too, a constant with NULLs stays, the row without time is dropped
    assert out.columns == ["datetime", "a", "almost"] and out.count() == 2
    assert manifest["dropped_exact_columns"] == ["rate_1d"] and manifest["dropped_all_null_columns"] == ["gone"]
    assert manifest["dropped_constant_columns"] == ["same", "label_7d"]
    kept, manifest = cleaning.apply_cleaning_rules(df, {**cleaning.CLEANING_RULES_V1, "drop_if_constant": False, "drop_if_all_null": False})
    assert "same" in kept.columns and "gone" in kept.columns and manifest["dropped_constant_columns"] == []


def test_missing_columns_are_an_error(spark):
    path = shared_dir(spark, "odd")
    spark.createDataFrame([("2020-01-01", 1.0)], "datetime string, lat double").write.csv(path, header=True)
    with pytest.raises(ValueError):
        read_catalog_any(spark, path)


def test_broken_document_loses_only_itself(spark):
    path = shared_dir(spark, "broken")
    good = '{"features":[{"id":"a","properties":{"time":1000,"mag":4.5},"geometry":{"coordinates":[1.0,2.0]}},{"id":"b","properties":{"time":1000,"mag":null},"geometry":{"coordinates":[1.0,2.0,3.0]}}]}'
    spark.createDataFrame([(good,), ('{"features":[{"id":',)], "value string").write.text(path)
    rows = parse_geojson_events(spark, path, one_per_line=True).collect()
    assert [(r.event_id, r.latitude, r.longitude, r.depth) for r in rows] == [("a", 2.0, 1.0, None)]




def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_plan_has_no_nested_loop_and_reads_few_columns(spark, folder):
    t = Tables(spark, folder)
    plan = plan_of(window_features(t.catalog.where("magnitude >= 4"), t.catalog))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert "props" not in plan


@pytest.mark.parametrize("name", ["radius_count", "nearest_station", "nearest_line_km", "forward_labels", "elapsed_since_last", "followup_exists"])
def test_no_cross_joins(spark, folder, name):
    plan = plan_of(checks.PLAIN[name](spark, folder))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan


checks.load()


def test_shuffle_partitions_follow_the_input(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 0) == spark.sparkContext.defaultParallelism
        assert size_shuffles(spark, 10**12) > 20_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
