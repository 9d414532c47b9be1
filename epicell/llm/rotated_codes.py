"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is centred, rotated at random and kept as the signs of its coordinates. Two scalars
of a vector turn the inner product of its signs with a query into an unbiased estimate; its error is
bounded with a stated confidence, and only vectors whose bound reaches the best found are
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.blocks import BLOCK_ROWS, best, by_length, first_copies, numbered_blocks, search_blocks, usable_vectors
from epicell.session import settle

# width of the error bound in standard deviations
CONFIDENCE = 2.5
# a query is rounded to so many bits for the bit arithmetic
QUERY_BITS = 6

FOUND = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]
)


@dataclass
class Rotation:
    centre: np.ndarray
    matrix: np.ndarray

    @staticmethod
    def random(centre: np.ndarray, seed: int = 17) -> "Rotation":
        """The same random orthogonal matrix for every block and query."""
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(centre), len(centre))))
        return Rotation(centre, q * np.sign(np.diag(r)))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs; length of the centred vector; its inner product with its code; that of the vector with the centre.

        A vector at the centre has length 0 and an estimate without error.
        """
        off = vectors - self.centre
        length = np.linalg.norm(off, axis=1)
        turned = off @ self.matrix
        bits = turned > 0
        aligned = np.abs(turned).sum(axis=1) / np.sqrt(len(self.centre))
        aligned = np.divide(aligned, length, out=np.ones_like(length), where=length > 0)
        return np.packbits(bits, axis=1, bitorder="little"), length, aligned, off @ self.centre


def words(codes: np.ndarray) -> np.ndarray:
    """Packed bytes as 64-bit words, padded with zeros."""
    wide = -(-codes.shape[1] // 8) * 8
    out = np.zeros((len(codes), wide), dtype=np.uint8)
    out[:, : codes.shape[1]] = codes
    return out.view(np.uint64)


def sign_products(codes: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, float]:
    """<signs, query> for all codes from counts of common bits, and a bound of the rounding error.

    The query is rounded to QUERY_BITS bits between its extremes; each bit plane is one mask.
    """
    d = len(query)
    low, high = query.min(), query.max()
    width = (high - low) / (2**QUERY_BITS - 1) or 1.0
    level = np.rint((query - low) / width).astype(np.uint8)
    planes = words(np.stack([np.packbits(level >> b & 1, bitorder="little") for b in range(QUERY_BITS)]))
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    common = np.zeros(len(codes), dtype=np.int64)
    for b in range(QUERY_BITS):
        common += np.bitwise_count(codes & planes[b]).sum(axis=1, dtype=np.int64) << b
    # signs are +-1: twice the sum over set bits less the sum of all
    product = 2 * (low * ones + width * common) - (low * d + width * float(level.sum()))
    return product, float(np.abs(query - (low + width * level)).sum())


def search_block(block: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, rotation: Rotation, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the k best of a block (ids, exact scores), those that the bounds let through compared exactly.

    Estimate: <v, q> = <c, q> + <v - c, c> + |v - c| |q - c| <o, p>, with unit vectors o and p of the centred
    vector and query, and <o, p> estimated by <code, p> / <code, o>.
    """
    d = len(rotation.centre)
    spread = CONFIDENCE * np.sqrt(np.maximum(0, 1 - block["aligned"] ** 2)) / block["aligned"] / np.sqrt(max(1, d - 1))
    codes = words(block["code"])
    out = []
    for query_id, q in zip(ids, queries):
        off = q - rotation.centre
        size = float(np.linalg.norm(off))
        turned = off @ rotation.matrix / size if size else np.zeros(d)
        product, rounding = sign_products(codes, turned)
        scale = block["length"] * size
        estimate = rotation.centre @ q + block["with_centre"] + scale * product / np.sqrt(d) / block["aligned"]
        error = scale * (spread + rounding / np.sqrt(d) / block["aligned"]) + 1e-9
        own = block["id"] == query_id
        least = np.where(own, -np.inf, estimate - error)
        wanted = min(k, len(least) - int(own.sum()))
        if wanted <= 0:
            continue
        bar = np.partition(least, len(least) - wanted)[len(least) - wanted]
        rows = np.flatnonzero((estimate + error >= bar) & ~own)
        exact = np.einsum("ij,j->i", block["vector"][rows], q)
        order = np.lexsort((block["id"][rows], -exact))[:k]
        out.append((int(query_id), block["id"][rows][order], exact[order]))
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def build_index(rows: DataFrame, rotation: Rotation, block: Column) -> DataFrame:
    """(block, id, vector, code, length, aligned, with_centre) of every row (id, vector)."""
    source = rows.select(block.alias("block"), "id", "vector")
    added = [("code", T.BinaryType()), ("length", T.DoubleType()), ("aligned", T.DoubleType()), ("with_centre", T.DoubleType())]
    schema = T.StructType([*source.schema.fields, *[T.StructField(n, t) for n, t in added]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, *scalars = rotation.encode(_matrix(pa.chunked_array([batch.column(2)])))
                new = [pa.array([c.tobytes() for c in code], pa.binary()), *[pa.array(s) for s in scalars]]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=arrow)

    return source.mapInArrow(run, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest inner product, per query.

    Scores are exact inner products in double precision, best first, ties to the smaller id; a query's own id is no
    candidate, and with fewer than k candidates all are given. The bounds hold for a candidate with the confidence
    of CONFIDENCE standard deviations, so a true neighbour can be missed, rarely; what is given is exact.

    Rows whose key or vector is NULL, or whose vector is empty, zero or holds NULL or non-finite components, take no
    part on either side. Each query meets the vectors of its own length; every length has an index of its own. Repeated ids of one vector count once. Equal vectors are indexed as often as
    can matter (k + 1 copies). Other columns are ignored; an empty side gives no rows.
    """

    def usable(df: DataFrame) -> DataFrame:
        return usable_vectors(df, key, vector).where(F.exists("vector", lambda x: x != 0))

    def compare(table: pa.Table, wanted: pa.Table, rotation: Rotation) -> pa.Table:
        block = {c: table[c].to_numpy() for c in ("id", "length", "aligned", "with_centre")}
        block["vector"] = _matrix(table["vector"])
        block["code"] = np.frombuffer(b"".join(table["code"].to_pylist()), dtype=np.uint8).reshape(table.num_rows, -1)
        order = np.argsort(block["id"])
        block = {c: v[order] for c, v in block.items()}
        found = search_block(block, wanted["id"].to_numpy(), _matrix(wanted["vector"]), rotation, k)
        return pa.table(
            {
                "query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]).astype(np.int64),
                "vec_id": np.concatenate([i for _, i, _ in found] or [np.zeros(0, np.int64)]),
                "score": np.concatenate([s for _, _, s in found] or [np.zeros(0)]),
            }
        )

    def search(rows: DataFrame, asked: DataFrame, d: int, n: int) -> DataFrame:
        rows = rows.distinct()
        centre = rows.select([F.avg(F.col("vector")[i]).alias(f"c{i}") for i in range(d)]).first()
        rotation = Rotation.random(np.array(centre, dtype=float))
        blocks, block = numbered_blocks(n, BLOCK_ROWS, F.col("id"))
        index = build_index(first_copies(rows, k + 1), rotation, block)
        return best(search_blocks(index, asked, blocks, asked.count(), lambda t, q: compare(t, q, rotation), FOUND), k)

    return by_length(usable(vectors), settle(usable(queries).distinct(), "queries"), search, FOUND)
