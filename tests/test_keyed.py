"""The keyed table against a dictionary, its size of writes, and what failures leave."""

import os
import random

import pytest
from pyspark.sql import functions as F

from epicell.session import shared_dir
from epicell.sources.keyed import KeyedTable

SCHEMA = "k string, v int, at long"


def content(table):
    return {r.k: (r.v, r.at) for r in table.read().collect()}


def files_of(table):
    found = {}
    for folder in os.listdir(f"{table.path}/runs"):
        found[folder] = sum(len(f) for _, _, f in os.walk(f"{table.path}/runs/{folder}"))
    return found


def test_equals_a_dictionary_over_many_merges(spark):
    rng = random.Random(1)
    table = KeyedTable(spark, shared_dir(spark, "keyed"), "k", buckets=3, fan=3)
    want = {}
    for number in range(11):
        batch = [(f"k{rng.randrange(25)}", rng.randrange(1000), rng.randrange(6)) for _ in range(8)]
        batch = list({(k, at): (k, v, at) for k, v, at in batch}.values())  # no ties inside a batch
        table.merge(spark.createDataFrame(batch, SCHEMA), ["at"])
        for k, v, at in sorted(batch, key=lambda r: r[2]):
            if k not in want or at >= want[k][1]:
                want[k] = (v, at)
        assert content(table) == want
    assert len(table.commit().runs) <= 2 * 3
    # only what the last commits name is kept
    assert len(files_of(table)) <= 3 * 6


def test_a_batch_writes_its_own_rows(spark):
    table = KeyedTable(spark, shared_dir(spark, "keyed"), "k", buckets=4, fan=100)
    table.merge(spark.range(5000).selectExpr("concat('k', id) AS k", "1 AS v", "1L AS at"), ["at"])
    first = set(files_of(table))
    table.merge(spark.createDataFrame([("k7", 2, 2), ("k9", 2, 2)], SCHEMA), ["at"])
    added = set(files_of(table)) - first
    assert first <= set(files_of(table)) and len(added) == 1
    assert spark.read.parquet(f"{table.path}/runs/{added.pop()}").count() == 2
    assert table.read().count() == 5000 and content(table)["k7"] == (2, 2)


def test_deleted_keys_stay_away_until_written_again(spark):
    table = KeyedTable(spark, shared_dir(spark, "keyed"), "k", buckets=2, fan=3)
    table.merge(spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 5)], SCHEMA), ["at"])
    table.merge(spark.createDataFrame([("a", 0, 2), ("c", 0, 2)], SCHEMA), ["at"], gone=F.col("v") == 0)
    assert content(table) == {"b": (1, 1), "c": (1, 5)}
    table.merge(spark.createDataFrame([("a", 9, 1)], SCHEMA), ["at"])  # older than its deletion
    assert content(table) == {"b": (1, 1), "c": (1, 5)} and len(table.commit().runs) == 1
    table.merge(spark.createDataFrame([("a", 9, 3)], SCHEMA), ["at"])
    assert content(table) == {"a": (9, 3), "b": (1, 1), "c": (1, 5)}


@pytest.mark.parametrize("step", ["_write_run", "_publish"])
def test_a_failed_compaction_loses_nothing(spark, monkeypatch, step):
    table = KeyedTable(spark, shared_dir(spark, "keyed"), "k", buckets=2, fan=2)
    table.merge(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA), ["at"])
    real = getattr(KeyedTable, step)
    calls = []

    def failing(self, *args):
        calls.append(args)
        if len(calls) == 2:  # the first one is the batch itself
            raise RuntimeError("executor lost")
        return real(self, *args)

    monkeypatch.setattr(KeyedTable, step, failing)
    with pytest.raises(RuntimeError, match="executor lost"):
        table.merge(spark.createDataFrame([("b", 2, 2)], SCHEMA), ["at"])
    monkeypatch.undo()
    again = KeyedTable(spark, table.path, "k", buckets=2, fan=2)
    assert content(again) == {"a": (1, 1), "b": (2, 2)}
    again.merge(spark.createDataFrame([("c", 3, 3)], SCHEMA), ["at"])
    assert content(again) == {"a": (1, 1), "b": (2, 2), "c": (3, 3)}
    named = {r.folder for n in again._numbers() for r in again._load(n).runs}
    assert set(files_of(again)) == named


def test_new_columns_and_other_orders(spark):
    table = KeyedTable(spark, shared_dir(spark, "keyed"), "k", buckets=2)
    assert table.read() is None and not table.exists()
    table.merge(spark.createDataFrame([("a", 1, 1)], SCHEMA), ["at"])
    table.merge(spark.createDataFrame([("b", 1, 1, "x")], SCHEMA + ", more string"), ["at"])
    assert {(r.k, r.more) for r in table.read().collect()} == {("a", None), ("b", "x")}
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([("a", 1, 1)], SCHEMA), ["v"])


def test_some_buckets_are_read_alone(spark):
    table = KeyedTable(spark, shared_dir(spark, "keyed"), "k", buckets=4)
    for v in (1, 2):
        table.merge(spark.range(40).selectExpr("concat('k', id) AS k", f"{v} AS v", f"{v}L AS at"), ["at"])
    parts = [{r.k for r in table.read([b]).collect()} for b in range(4)]
    assert sum(map(len, parts)) == 40 == len(set().union(*parts))
    plan = table.read([1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
