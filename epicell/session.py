"""Session settings every job relies on, and the shared working folder."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # all interval arithmetic is on UTC microseconds
    "spark.sql.session.timeZone": "UTC",
    # let the runtime size partitions, pick broadcast joins by measured bytes, split skew
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the joins multiply few bytes into much work: small partitions may stay apart while cores are free
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32KB",
}

BYTES_PER_TASK = 128 * 1024 * 1024

# call-site capture costs a JVM round trip per column expression; long plans feel it
DEBUGGING = "spark.python.sql.dataFrameDebugging.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.isModifiable(DEBUGGING):
        spark.conf.set(DEBUGGING, "false")
    return spark


def size_shuffles(spark: SparkSession, input_bytes: int, expansion: float = 3.0) -> int:
    """Set the shuffle partitions for an input size, so that a partition fits an executor's share.

    `expansion` is how much a job multiplies its input before the widest shuffle (cells and
    buckets of a neighbour join). The runtime merges partitions that turn out small.
    """
    wanted = max(spark.sparkContext.defaultParallelism, int(input_bytes * expansion / BYTES_PER_TASK) + 1)
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def local_session(app: str = "epicell", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config(DEBUGGING, "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder that the cluster names.

    Only a local master may fall back to the machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="epicell-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what `settle` writes inside, on leaving. For jobs that end with their own output,
    such as a micro-batch; frames built inside must not be used afterwards."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives executors."""
    path = shared_dir(df.sparkSession, purpose)
    kept = _written.get()
    if kept is not None:
        kept.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*builders: Callable[[], DataFrame]) -> list[DataFrame]:
    """Build frames whose construction runs small jobs of its own at the same time."""
    with ThreadPoolExecutor(len(builders)) as pool:
        jobs = [pool.submit(contextvars.copy_context().run, b) for b in builders]
        return [job.result() for job in jobs]
