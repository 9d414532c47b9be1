"""Writers: partitioned data sets, the append-only log, snapshots."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epicell.constants import SERVING_DEFAULTS
from epicell.operators.shape import pick_last


def write_dataset(
    df: DataFrame, path: str, partition_cols: Sequence[str] = (), fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode).partitionBy(*partition_cols) if partition_cols else df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def serving_metadata() -> dict[str, str]:
    """The five version values; an environment variable wins over the default."""
    return {k: os.getenv(f"SERVING_{k.upper()}", default) for k, default in SERVING_DEFAULTS.items()}


def add_serving_metadata(df: DataFrame, meta: dict[str, str] | None = None) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in {**serving_metadata(), **(meta or {})}.items()})


def features_used_as_int(df: DataFrame, name: str = "features_used") -> DataFrame:
    """An int stays, a collection becomes its length, anything else NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        value = F.col(name).cast("int")
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        value = F.when(F.col(name).isNotNull(), F.size(name))
    else:
        value = F.lit(None).cast("int")
    return df.withColumn(name, value)


def upsert_scored_events(
    target: DataFrame, batch: DataFrame, key: str = "event_id", meta: dict[str, str] | None = None
) -> DataFrame:
    """Both sides merged, the last write per key wins; batch rows carry the serving metadata.

    A write counts as later by scored_us, then by prediction_id, then by being in the batch.
    """
    fresh = add_serving_metadata(batch, meta)
    both = target.withColumn("is_new", F.lit(0)).unionByName(
        fresh.withColumn("is_new", F.lit(1)), allowMissingColumns=True
    )
    order = [F.col(c) for c in ("scored_us", "prediction_id", "is_new") if c in both.columns]
    return pick_last(both, [key], order).drop("is_new")


LOG_COLUMNS = (
    "prediction_id event_id event_us latitude longitude depth magnitude prob_7d prob_30d risk_7d risk_30d features_used"
    " scored_us model_version benchmark_id feature_set_version dataset_version mlflow_run_id batch_id"
).split()


def append_prediction_log(batch: DataFrame, path: str) -> None:
    """Append served predictions; the log has no 365-day columns. Each row gets its own id.

    Partitioned by model version: asking what a model has logged reads that model's part only.
    """
    rows = batch.withColumn("prediction_id", F.expr("uuid()")) if "prediction_id" not in batch.columns else batch
    kept = rows.select(*[c for c in LOG_COLUMNS if c in rows.columns])
    kept.write.mode("append").partitionBy("model_version").parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class Snapshots:
    """A table as numbered immutable snapshots; the newest finished one is current.

    A snapshot is finished when Spark's commit marker is in its folder, so a lost job leaves
    the previous one in place, and a repeated batch rewrites its own number only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def numbers(self) -> list[int]:
        fs, root = _fs(self.spark, self.path)
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("v=") and fs.exists(marker):
                found.append(int(name[2:]))
        return sorted(found)

    def read(self, below: int | None = None) -> DataFrame | None:
        """The newest snapshot, or the newest one before number `below`."""
        known = [n for n in self.numbers() if below is None or n < below]
        return self.spark.read.parquet(f"{self.path}/v={known[-1]}") if known else None

    def write(self, df: DataFrame, number: int, keep: int = 3) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        fs, _ = _fs(self.spark, self.path)
        for old in self.numbers()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}"), True)
