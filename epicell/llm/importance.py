"""Resampling of documents towards a target distribution by the importance of their hashed word n-grams.

Texts are brought to words with one space between them. One scan of a regular expression, with overlapping
matches that start at every blank before a word, gives the spans of all n-grams at once; their crc32 picks a bucket. The
log ratio of target and source counts of a bucket is its gain, the gains of a document's features make its
weight, and Gumbel noise from a hash of its key turns the largest scores into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.common import col, map_texts
from epicell.operators.order_stats import RANGE_BITS, value_key
from epicell.session import settle

LONGEST = 3
BUCKETS = 10_000
MIN_WORDS = 20
SHARE_PERCENT = 5
SEED = "42"

# ---- fixed values: bytes that separate words (all below U+0080 that are no digit and no letter), upper case to lower ----
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
# ---- end of fixed values ----
CLEAN = bytes.maketrans(SEPARATORS + UPPER, b" " * len(SEPARATORS) + LOWER)

# private columns
ROW, RANGE, AT = "llm_row", "llm_range", "llm_at"


def words_of(text: str) -> bytes:
    """The words of a text with one space between, in lower case (A to Z only)."""
    return b" ".join(text.encode().translate(CLEAN).split())


def overlapping_ngrams(longest: int) -> regex.Pattern:
    """Matches at each word; group `longest - n + 1` holds its n-gram, or a shorter one where the text ends.

    The blank before a word belongs to the match, so that the scanner can jump to it; the blank after the
    last word is looked at only, and overlapping matches take it up again.
    """
    spans = rb"([^ ]++)"
    for _ in range(longest - 1):
        spans = rb"(" + spans + rb"(?: [^ ]++)?+)"
    return regex.compile(rb" " + spans + rb"(?= )")


@dataclass
class NgramHasher:
    """Buckets of all n-grams of a text, for n from 1 to `longest`."""

    longest: int
    buckets: int
    pattern: regex.Pattern = field(init=False)

    def __post_init__(self) -> None:
        self.pattern = overlapping_ngrams(self.longest)

    @property
    def dtype(self) -> str:
        return "<u2" if self.buckets <= 1 << 16 else "<u4"

    def hash(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets: all of one word first, then all of two, and so on."""
        clean = words_of(text)
        matches = self.pattern.finditer(b" " + clean + b" ", overlapped=True)
        sums = np.fromiter(map(zlib.crc32, chain.from_iterable([m.groups() for m in matches])), dtype=np.uint32)
        table = (sums % np.uint32(self.buckets)).astype(self.dtype).reshape(-1, self.longest)
        n = len(table)
        return n, np.concatenate([table[: max(0, n - k), self.longest - 1 - k] for k in range(self.longest)])


def ngram_features(
    documents: DataFrame, keep: list[str] | None = None, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS
) -> DataFrame:
    """Adds `n_words`, `n_features` and `features` to the columns `keep`: the bucket of every n-gram of the whole text.

    `features` is a little-endian unsigned array of 16 bits (32 beyond 65,536 buckets). A NULL or empty text, or one
    without a word, has none. Columns named like those added are replaced.
    """

    def start() -> Callable[[list[str]], dict[str, object]]:
        hasher = NgramHasher(longest, buckets)

        def step(texts: list[str]) -> dict[str, object]:
            found = [hasher.hash(t) for t in texts]
            return {
                "n_words": [n for n, _ in found],
                "n_features": [len(b) for _, b in found],
                "features": [b.tobytes() for _, b in found],
            }

        return step

    fields = [("n_words", T.LongType()), ("n_features", T.LongType()), ("features", T.BinaryType())]
    return map_texts(documents, text, documents.columns if keep is None else keep, fields, start)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows of `ngram_features`. Tasks add up first: one row a task and bucket."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)
    dtype = NgramHasher(1, buckets).dtype

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), dtype=dtype), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=arrow)

    counted = features.select("features").mapInArrow(count, schema).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of the smoothed shares of each bucket in the target and in the source."""
    size = len(source)
    all_source, all_target = int(source.sum()) + size, int(target.sum()) + size
    ratios = (((t + 1) * all_source) / ((s + 1) * all_target) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def weigh(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """Adds `weight`, the sum of the gains over a row's features, in place of `features`."""
    shared = features.sparkSession.sparkContext.broadcast(gains)
    dtype = NgramHasher(1, len(gains)).dtype
    at = features.columns.index("features")
    schema = T.StructType([f for f in features.schema.fields if f.name != "features"] + [T.StructField("weight", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            weights = [int(table[np.frombuffer(v.as_buffer(), dtype=dtype)].sum()) for v in batch.column(at)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weights, pa.int64())], schema=arrow)

    return features.mapInArrow(run, schema)


def gumbel(key: Column, seed: str = SEED) -> Column:
    """floor(1000 times Gumbel noise) from the first 32 bits of the sha256 of seed and key; a NULL key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def rank_largest(scored: DataFrame, eligible: Column, percent: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """Adds `rank`: 1, 2, 3 ... by falling score, ties to the smaller key, for floor(percent * N / 100) of the N
    eligible rows, else NULL. NULL keys come last; rows with equal keys and scores follow each other in any order.

    `scored` must be a written table. No task sees all rows: ranges of the score are counted first (their
    number is bounded by the format of a double), rows under the range in which the draw ends are left alone, the
    others are dealt by range, sorted within, and numbered from the sizes of the ranges before.
    """
    spark = scored.sparkSession
    rows = scored.withColumn(RANGE, F.when(eligible, F.shiftright(value_key(col(score).cast("double")), RANGE_BITS[0])))
    sizes = {r[RANGE]: r["n"] for r in rows.where(F.col(RANGE).isNotNull()).groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = percent * sum(sizes.values()) // 100
    names = scored.columns
    undrawn = [*[col(c) for c in names], F.lit(None).cast("long").alias("rank")]
    if not drawn:
        return rows.select(*undrawn)
    total, last = 0, None
    for last in sorted(sizes, reverse=True):
        total += sizes[last]
        if total >= drawn:
            break
    high = F.coalesce(F.col(RANGE) >= last, F.lit(False))
    order = [col(score).desc(), col(key).asc_nulls_last(), F.col(ROW)]
    dealt = rows.where(high).withColumn(ROW, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # a row's place: number of its range, and in the low 33 bits its place in it
    placed = settle(dealt.select(*[col(c) for c in names], F.monotonically_increasing_id().alias(AT)), "drawn")
    part = F.shiftright(AT, 33)
    before, starts = 0, []
    for row in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((row["part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(starts, "llm_part long, llm_before long")
    # one row for each range that was dealt
    numbered = placed.join(F.broadcast(offsets), part == F.col("llm_part"))
    rank = F.col("llm_before") + F.col(AT) - F.shiftleft(part, 33) + 1
    ranked = numbered.select(*[col(c) for c in names], F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(rows.where(~high).select(*undrawn))


def resample(
    documents: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = SHARE_PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; the drawn ones have a rank.

    Of the N documents with at least `min_words` words the floor(percent * N / 100) largest scores are drawn. Counts are
    of all n-grams of all whole texts of both tables. NULL, empty and wordless texts weigh 0; a
    NULL key is drawn like any other and comes last in ties; rows with the same key are documents of their own. An empty
    table gives no rows, an empty target equal shares. Other columns are not used.
    """
    source = documents.select(col(key), col(text).cast("string").alias("llm_text"))
    wanted = target.select(col(target_text).cast("string").alias("llm_text"))
    features = settle(ngram_features(source, [key], "llm_text", longest, buckets), "ngrams")
    of_target = ngram_features(wanted, [], "llm_text", longest, buckets)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(of_target, buckets))
    weighed = weigh(features, gains)
    scored = settle(weighed.withColumn("score", F.col("weight") + gumbel(col(key), seed)), "scored")
    return rank_largest(scored, F.col("n_words") >= min_words, percent, key)
