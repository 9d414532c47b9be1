"""A stated set of queries against all rows, block by block."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.common import col

# rows of the table that one task compares at a time, and queries likewise
BLOCK_ROWS = 8192
BLOCK_QUERIES = 32_768


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that can take part: a key, and finite components without NULL."""
    v = col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(col(key).cast("long").alias("id"), v.alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def by_length(
    rows: DataFrame, asked: DataFrame, search: Callable[[DataFrame, DataFrame, int, int], DataFrame], result: T.StructType
) -> DataFrame:
    """`search(rows, queries, length, n)` for every length that the n vectors of some rows have, one after the other.

    Vectors of different lengths have no inner product: a query meets the candidates of its own length.
    """
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    out = None
    for d, n in sizes:
        found = search(rows.where(F.size("vector") == d), asked.where(F.size("vector") == d), d, n)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = T.StructType([result[0], T.StructField("rank", T.IntegerType()), *result[1:]])
        return rows.sparkSession.createDataFrame([], kinds)
    return out


def first_copies(rows: DataFrame, copies: int) -> DataFrame:
    """Of rows with equal vectors the `copies` smallest ids.

    Equal vectors have equal scores and ties go to the smaller id, so of one vector no more can be among
    the best of any query. Spark keeps that many per vector before the shuffle already, so a
    vector that a third of all rows share is a few rows of each task.
    """
    rank = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= copies).drop("rank")


def numbered_blocks(n: int, size: int, key: Column) -> tuple[int, Column]:
    """Number of blocks of about `size` rows, and the block of a key."""
    blocks = max(1, -(-n // size))
    return blocks, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def search_blocks(
    index: DataFrame,
    queries: DataFrame,
    index_blocks: int,
    n_queries: int,
    compare: Callable[[pa.Table, pa.Table], pa.Table],
    result: T.StructType,
) -> DataFrame:
    """`compare` on every block of the index with every block of the queries, rows of `result`.

    `index` has the column `block`. Each side is repeated for the blocks of the other, so a task holds one
    block of each, whatever the number of rows.
    """
    query_blocks, query_block = numbered_blocks(n_queries, BLOCK_QUERIES, F.col("id"))
    left = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("query_block", query_block)
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))))
    arrow = to_arrow_schema(result)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return arrow.empty_table()
        return compare(rows, asked).cast(arrow)

    keys = ["block", "query_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, result)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks, ties to the smaller id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
