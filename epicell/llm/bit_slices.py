"""Exact top-k search over a bit-sliced index.

Per block of rows and dimension the index keeps one bitmap for each bit of the quantised value. The
score of a query is added up for all rows of a block at once with bitmap arithmetic, the best rows
are chosen from the most significant slice of the sum downward, and rows near the boundary are resolved
with the exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.blocks import BLOCK_ROWS, best, by_length, first_copies, numbered_blocks, search_blocks, usable_vectors
from epicell.session import settle

# each component is kept in so many slices, its finer bits only in the exact values
SLICES = 6

INDEX = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("rows", T.IntegerType()),
        T.StructField("low", T.LongType()),
        T.StructField("shift", T.IntegerType()),
        T.StructField("slices", T.BinaryType()),
        T.StructField("exact", T.BinaryType()),
    ]
)
FOUND = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())]
)


def bitmaps(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Least value, dropped bits, and the slices [SLICES, words] of (value - least) >> dropped bits."""
    low = int(values.min())
    span = int(values.max()) - low
    shift = max(0, span.bit_length() - SLICES)
    level = (values - low) >> shift
    words = -(-len(values) // 64)
    out = np.zeros((SLICES, words * 8), dtype=np.uint8)
    for b in range(SLICES):
        packed = np.packbits((level >> b & 1).astype(np.uint8), bitorder="little")
        out[b, : len(packed)] = packed
    return low, shift, out.view(np.uint64)


def build_index(rows: DataFrame, block: Column) -> DataFrame:
    """A row per block and dimension, and one of dimension -1 that has the ids of the block's rows."""
    arrow = to_arrow_schema(INDEX)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        values = table["vector"].combine_chunks()
        matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        ids = table["id"].to_numpy()
        order = np.argsort(ids)
        ids, matrix = ids[order], matrix[order]
        at, n = key[0].as_py(), len(ids)
        out = [{"block": at, "dimension": -1, "rows": n, "low": 0, "shift": 0, "slices": b"", "exact": ids.astype("<i8").tobytes()}]
        for i in range(matrix.shape[1]):
            column = np.ascontiguousarray(matrix[:, i])
            low, shift, slices = bitmaps(column)
            out.append(
                {"block": at, "dimension": i, "rows": n, "low": low, "shift": shift, "slices": slices.tobytes(), "exact": column.astype("<i8").tobytes()}
            )
        return pa.Table.from_pylist(out, schema=arrow)

    return rows.withColumn("block", block).groupBy("block").applyInArrow(build, INDEX)


class Block:
    """The index of one block, ready for queries."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.to_pylist(), key=lambda r: r["dimension"])
        self.ids = np.frombuffer(rows[0]["exact"], dtype="<i8")
        self.n = rows[0]["rows"]
        self.low = [r["low"] for r in rows[1:]]
        self.shift = [r["shift"] for r in rows[1:]]
        self.slices = [np.frombuffer(r["slices"], dtype=np.uint64).reshape(SLICES, -1) for r in rows[1:]]
        self.exact = np.stack([np.frombuffer(r["exact"], dtype="<i8") for r in rows[1:]], axis=1)
        words = -(-self.n // 64)
        self.every = np.zeros(words * 8, dtype=np.uint8)
        self.every[: -(-self.n // 8)] = np.packbits(np.ones(self.n, dtype=np.uint8), bitorder="little")
        self.every = self.every.view(np.uint64)
        self.inverse = [~s for s in self.slices]

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the quantised score of all rows, least significant first, and its largest shortfall.

        A negative weight meets the complement of the slices, so nothing is ever subtracted: the score is a
        constant of the query and block, plus the sum, plus between 0 and the shortfall. Bitmaps of equal
        weight are added three at a time: one of that weight and one of the next come out.
        """
        waiting: dict[int, list[np.ndarray]] = {}
        short = 0
        for weight, shift, plain, inverse in zip(query.tolist(), self.shift, self.slices, self.inverse):
            size = abs(weight)
            short += size * ((1 << shift) - 1)
            chosen = plain if weight > 0 else inverse
            place = 0
            while size:
                if size & 1:
                    for b in range(SLICES):
                        waiting.setdefault(place + b + shift, []).append(chosen[b])
                size >>= 1
                place += 1
        out = []
        place = 0
        while place <= max(waiting, default=-1):
            maps = waiting.get(place, [])
            while len(maps) > 2:
                a, b, c = maps.pop(), maps.pop(), maps.pop()
                either = a ^ b
                maps.append(either ^ c)
                waiting.setdefault(place + 1, []).append(a & b | either & c)
            if len(maps) == 2:
                a, b = maps.pop(), maps.pop()
                maps.append(a ^ b)
                waiting.setdefault(place + 1, []).append(a & b)
            out.append(maps[0] if maps else np.zeros_like(self.every))
            place += 1
        return out, short

    def boundary(self, slices: list[np.ndarray], k: int, among: np.ndarray) -> int:
        """The k-th largest sum, found from the most significant slice downward."""
        sure, open_rows, value = 0, among.copy(), 0
        for place in range(len(slices) - 1, -1, -1):
            ones = open_rows & slices[place]
            n = int(np.bitwise_count(ones).sum())
            if sure + n >= k:
                open_rows = ones
                value |= 1 << place
            else:
                sure += n
                open_rows = open_rows & ~slices[place]
        return value

    @staticmethod
    def at_least(slices: list[np.ndarray], value: int, among: np.ndarray) -> np.ndarray:
        """The rows whose sum reaches a value."""
        if value <= 0:
            return among
        if value >> len(slices):
            return np.zeros_like(among)
        more, equal = np.zeros_like(among), among.copy()
        for place in range(len(slices) - 1, -1, -1):
            if value >> place & 1:
                equal = equal & slices[place]
            else:
                more |= equal & slices[place]
                equal = equal & ~slices[place]
        return more | equal

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows, the query's own left out, ties to the smaller id."""
        among = self.every.copy()
        own = np.flatnonzero(self.ids == query_id)
        for row in own:
            among[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        k = min(k, self.n - len(own))
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slices, short = self.sums(query)
        bar = self.boundary(slices, k, among) - short
        chosen = self.at_least(slices, bar, among)
        rows = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
        scores = self.exact[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query, exactly.

    A component x counts as floor(factor * x), in double precision. A query's own id is no candidate; ties go to the smaller id;
    with fewer than k candidates all are given. Rows whose key or vector is NULL, or whose vector is empty or
    holds NULL or non-finite components, take no part on either side. Each query meets the vectors of its own length. Repeated ids of one vector count once. Equal vectors are indexed as often as can matter (k + 1 copies). Other columns are
    ignored; an empty side gives no rows.
    """

    def usable(df: DataFrame) -> DataFrame:
        whole = F.transform("vector", lambda x: F.floor(x * factor).cast("long"))
        return usable_vectors(df, key, vector).select("id", whole.alias("vector")).distinct()

    def compare(table: pa.Table, wanted: pa.Table) -> pa.Table:
        block = Block(table)
        values = wanted["vector"].combine_chunks()
        matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        found = [(q, *block.top(q, v, k)) for q, v in zip(wanted["id"].to_pylist(), matrix)]
        return pa.table(
            {
                "query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64),
                "vec_id": np.concatenate([i for _, i, _ in found]).astype(np.int64),
                "score": np.concatenate([s for _, _, s in found]).astype(np.int64),
            }
        )

    def search(rows: DataFrame, asked: DataFrame, d: int, n: int) -> DataFrame:
        blocks, block = numbered_blocks(n, BLOCK_ROWS, F.col("id"))
        index = build_index(first_copies(rows, k + 1), block)
        return best(search_blocks(index, asked, blocks, asked.count(), compare, FOUND), k)

    return by_length(usable(vectors), settle(usable(queries), "queries"), search, FOUND)
