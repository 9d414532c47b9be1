"""Near duplicates by Jaccard similarity of word shingles, with Bayesian pruning of candidates.

Texts with equal sets of shingles collapse to one. MinHash bands propose candidates. A pair is
compared hash by hash, a few at a time, and dropped as soon as the posterior probability that it reaches the
threshold falls below a tolerance; what is left is verified on the shingles themselves.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.common import col, map_texts
from epicell.llm.components import connected_components
from epicell.session import settle

WORDS = 5
THRESHOLD = 0.8
# a pair at the threshold shares no band with probability (1 - 0.8^4)^24 = 3e-6
BANDS, BAND_HASHES = 24, 4
HASHES = BANDS * BAND_HASHES
# hashes compared at a time, and the posterior probability under which a pair is dropped
STEP_HASHES = 8
TOLERANCE = 1e-6
# texts that one task compares with each other: buckets and classes beyond are cut into tiles
BUCKET_TEXTS = 1024
CLASS_TEXTS = 512
CHUNK_ROWS = 8192
REMEMBERED_WORDS = 400_000

WORD = re.compile(r"\w+")
_RANDOM = np.random.default_rng(23)
_FACTORS = _RANDOM.integers(1, 2**63, WORDS, dtype=np.uint64) * 2 + 1
_MULTIPLIERS = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) * 2 + 1
_OFFSETS = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After n compared hashes a pair with fewer matches is dropped; by n = 0, STEP_HASHES, ...

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), and it reaches the
    threshold t with the probability that n + 1 throws of chance t succeed at most m times.
    """
    out = []
    for n in range(0, HASHES + 1, STEP_HASHES):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


class Shingler:
    """Distinct shingle hashes of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes = array("Q")

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of all runs of WORDS words; a shorter text is one run."""
        if len(self.known) > REMEMBERED_WORDS:
            self._forget()
        places, bounds = [], [0]
        for text in texts:
            words = WORD.findall(text.lower())
            found = list(map(self.known.get, words))
            if None in found:
                for i, place in enumerate(found):
                    if place is None:
                        word = words[i]
                        place = self.known.get(word)
                        if place is None:
                            place = self.known[word] = len(self.hashes)
                            self.hashes.append(xxhash.xxh64_intdigest(word))
                        found[i] = place
            places += found
            bounds.append(len(places))
        if not places:
            return [np.zeros(0, dtype=np.uint64) for _ in texts]
        words = np.frombuffer(self.hashes, dtype=np.uint64)[np.array(places, dtype=np.int64)]
        runs = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
        for j in range(WORDS):
            runs += words[j : j + len(runs)] * _FACTORS[j]
        runs = mix(runs)
        out = []
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo >= WORDS:
                out.append(np.unique(runs[lo : hi - WORDS + 1]))
            elif hi > lo:
                out.append(mix(np.array([(words[lo:hi] * _FACTORS[: hi - lo]).sum() + np.uint64(hi - lo)], dtype=np.uint64)))
            else:
                out.append(words[:0])
        return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values [texts, HASHES] of sets that are not empty."""
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    if sets:
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for k in range(HASHES):
            least = np.minimum.reduceat(flat * _MULTIPLIERS[k] + _OFFSETS[k], starts)
            out[:, k] = least >> np.uint64(32)
    return out


SIGNED = [("text_id", T.BinaryType()), ("shingles", T.IntegerType()), ("signature", T.BinaryType())]


def sign_texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, text_id, shingles, signature) of every row.

    `text_id` stands for the set of shingles: equal for texts with equal sets. A text without words has no
    signature, and its `text_id` stands for the text itself; that of a NULL text is NULL.
    """
    body = col(text).cast("string")
    source = documents.select(col(key).alias("key"), F.xxhash64(body).alias("text_hash"), body.isNotNull().alias("known"), body.alias("text"))

    def start() -> Callable[[list[str]], dict[str, object]]:
        shingler = Shingler()

        def step(texts: list[str]) -> dict[str, object]:
            sets = shingler.sets(texts)
            signed = iter(signatures([s for s in sets if len(s)]))
            return {
                "text_id": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                "shingles": [len(s) for s in sets],
                "signature": [next(signed).tobytes() if len(s) else None for s in sets],
            }

        return step

    signed = map_texts(source, "text", ["key", "text_hash", "known"], SIGNED, start)
    itself = F.concat(F.lit("wordless "), F.col("text_hash").cast("string")).cast("binary")
    return signed.withColumn("text_id", F.coalesce("text_id", F.when(F.col("known"), itself))).drop("known")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of at least CHUNK_ROWS rows of a sorted partition; a group is never torn.

    A group has a bounded number of rows, so a table has too.
    """
    waiting: list[pa.RecordBatch] = []
    rows = 0

    def last_group(table: pa.Table) -> int:
        end = table.num_rows
        same = np.ones(end, dtype=bool)
        for k in keys:
            column = table[k].to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        return int(end - np.flatnonzero(~same[::-1])[0]) if not same.all() else 0

    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            waiting.append(part)
            rows += part.num_rows
            if rows >= CHUNK_ROWS:
                table = pa.Table.from_batches(waiting)
                cut = last_group(table)
                if cut:
                    yield table.slice(0, cut)
                waiting, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(waiting)


def group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        column = table[k].to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def candidate_pairs(group: np.ndarray, part: np.ndarray, crossing: np.ndarray, signature: np.ndarray, floors: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that survive the pruning, distance by distance in the sorted rows.

    In a tile of two parts (`crossing`) only rows of different parts are compared. Hashes are compared
    STEP_HASHES at a time, and the pairs shrink after each step.
    """
    ends = np.searchsorted(group, group, side="right")
    rows = np.arange(len(group))
    for lag in range(1, int((ends - rows).max(initial=1))):
        i = rows[: len(rows) - lag]
        i = i[i + lag < ends[i]]
        i = i[~crossing[i] | (part[i] != part[i + lag])]
        matches = np.zeros(len(i), dtype=np.int64)
        for step, floor in enumerate(floors[1:]):
            if not len(i):
                break
            hashes = slice(step * STEP_HASHES, (step + 1) * STEP_HASHES)
            matches += (signature[i, hashes] == signature[i + lag, hashes]).sum(axis=1)
            good = matches >= floor
            i, matches = i[good], matches[good]
        if len(i):
            yield i, i + lag


class Forest:
    """Roots of rows that are joined one after the other."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        open_pairs = self.root[i] != self.root[j]
        while open_pairs.any():
            i, j = i[open_pairs], j[open_pairs]
            a, b = self.root[i], self.root[j]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                deeper = self.root[self.root]
                if (deeper == self.root).all():
                    break
                self.root = deeper
            open_pairs = self.root[i] != self.root[j]


def tiles(rows: DataFrame, n: Column, size: int, spread: Column) -> DataFrame:
    """Adds (part, tile_a, tile_b): a group of n rows is cut into parts of about `size`, each pair of parts is a tile.

    Two rows of a group meet in one tile exactly, and a tile has two parts at most, however large
    the group is.
    """
    parts = F.ceil(n / size).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(spread, F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"tile_a": F.least("part", "other"), "tile_b": F.greatest("part", "other")}).drop("other", "parts")


def _binary(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def candidate_edges(texts: DataFrame) -> DataFrame:
    """(a, b) of text ids that join all candidate pairs; no more edges than rows of the buckets.

    `texts` has a row per text (text_id, signature).
    """
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substr(F.col("signature"), b * 4 * BAND_HASHES + 1, F.lit(4 * BAND_HASHES))),
    )
    banded = texts.select("text_id", F.explode(keys).alias("bucket"))
    # written, so that the join is one of bare shuffles and a bucket of a third of all texts is split
    shared = settle(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    members = banded.join(shared, "bucket")
    tiled = tiles(members, F.col("members"), BUCKET_TEXTS, F.xxhash64("text_id"))
    tiled = tiled.select("bucket", "tile_a", "tile_b", "part", "text_id").join(texts.select("text_id", "signature"), "text_id")
    order = ["bucket", "tile_a", "tile_b"]
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    floors = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, order):
            group = group_numbers(table, order)
            signature = _binary(table["signature"], np.uint32).reshape(-1, HASHES)
            crossing = (table["tile_a"].to_numpy() != table["tile_b"].to_numpy())
            forest = Forest(table.num_rows)
            for i, j in candidate_pairs(group, table["part"].to_numpy(), crossing, signature, floors):
                forest.join(i, j)
            joined = np.flatnonzero(forest.root != np.arange(table.num_rows))
            ids = table["text_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(joined)), ids.take(pa.array(forest.root[joined]))], schema=arrow)

    dealt = tiled.repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema)


def verified_links(rows: DataFrame) -> DataFrame:
    """Exact links within groups: (text_id, root, texts, documents) per row and tile.

    `rows` has (component, members, text_id, copies, text). `texts` and `documents` count what a text
    links to in that tile, `root` is a text of the tile that it is joined with by links. Shingles that
    one text of a tile has alone cannot be shared, so the sets shrink to bitmaps over the rest.
    """
    added = [("shingles", T.BinaryType()), ("signature", T.BinaryType())]
    order = ["component", "tile_a", "tile_b"]

    def start() -> Callable[[list[str]], dict[str, object]]:
        shingler = Shingler()

        def step(texts: list[str]) -> dict[str, object]:
            sets = shingler.sets(texts)
            return {"shingles": [s.tobytes() for s in sets], "signature": [s.tobytes() for s in signatures(sets)]}

        return step

    # every text is shingled once, however many tiles it is in
    kept = ["component", "members", "text_id", "copies"]
    shingled = settle(map_texts(rows, "text", kept, added, start), "shingles")
    tiled = tiles(shingled, F.col("members"), CLASS_TEXTS, F.xxhash64("text_id")).drop("members")
    schema = T.StructType(
        [
            T.StructField("text_id", T.BinaryType()),
            T.StructField("root", T.BinaryType()),
            T.StructField("texts", T.LongType()),
            T.StructField("documents", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    floors = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, order):
            group = group_numbers(table, order)
            n = table.num_rows
            copies = table["copies"].to_numpy()
            crossing = table["tile_a"].to_numpy() != table["tile_b"].to_numpy()
            signature = _binary(table["signature"], np.uint32).reshape(-1, HASHES)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in table["shingles"].to_pylist()]
            size = np.array([len(s) for s in sets])
            forest, texts, documents = Forest(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            common = [None] * n
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], n]):
                flat = np.concatenate(sets[lo:hi])
                values, places, counts = np.unique(flat, return_inverse=True, return_counts=True)
                number = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[places]
                width = max(1, -(-int((counts > 1).sum()) // 64))
                bits = np.zeros((hi - lo, width * 64), dtype=bool)
                owner = np.repeat(np.arange(hi - lo), size[lo:hi])
                bits[owner[number >= 0], number[number >= 0]] = True
                packed = np.packbits(bits, axis=1).view(np.uint64)
                for k in range(lo, hi):
                    common[k] = packed[k - lo]
            for i, j in candidate_pairs(group, table["part"].to_numpy(), crossing, signature, floors):
                shared = np.fromiter(
                    (int(np.bitwise_count(common[a] & common[b]).sum()) for a, b in zip(i, j)), dtype=np.int64, count=len(i)
                )
                # |A and B| / |A or B| >= t, without division
                good = shared >= THRESHOLD * (size[i] + size[j] - shared) - 1e-9
                i, j = i[good], j[good]
                np.add.at(texts, i, 1)
                np.add.at(texts, j, 1)
                np.add.at(documents, i, copies[j])
                np.add.at(documents, j, copies[i])
                forest.join(i, j)
            ids = table["text_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(forest.root)), pa.array(texts), pa.array(documents)], schema=arrow)

    dealt = tiled.repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema)


def _text_classes(signed: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """(text_id, keeper, n_links, n_linked_texts) of every text; keeper is the least document of the class.

    Texts without words are classes of exact copies, without links.
    """
    least = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "text_hash"))
    texts = settle(
        signed.where(F.col("signature").isNotNull())
        .groupBy("text_id")
        .agg(F.count(F.lit(1)).alias("copies"), least.alias("least"), F.first("signature").alias("signature")),
        "texts",
    )
    proposed = connected_components(candidate_edges(texts))
    # aggregates are written before they are joined back: the runtime splits bare shuffles only
    sizes = settle(proposed.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "sizes")
    groups = proposed.withColumnRenamed("node", "text_id").join(sizes, "component")
    whose = texts.select("text_id", "copies", F.col("least.key").alias("llm_key"), F.col("least.text_hash").alias("text_hash"))
    chosen = settle(groups.join(whose, "text_id"), "chosen")
    hashed = F.xxhash64(col(text).cast("string"))
    source = documents.select(col(key).alias("key"), hashed.alias("text_hash"), col(text).cast("string").alias("text"))
    # of the copies of a text only the document with the least key meets its row, so they are dealt by their keys
    one = chosen.select("llm_key", F.col("text_hash").alias("llm_hash"))
    same = F.col("key").eqNullSafe(F.col("llm_key")) & (F.col("text_hash") == F.col("llm_hash"))
    bodies = source.join(one, same, "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    chosen = chosen.drop("llm_key")
    links = settle(verified_links(chosen.join(bodies, "text_hash").drop("text_hash")), "links")
    classes = connected_components(links.select(F.col("text_id").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("text_id").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    joined = (
        texts.select("text_id", "copies", "least")
        .join(counted, "text_id", "left")
        .join(classes.withColumnRenamed("node", "text_id").withColumnRenamed("component", "class"), "text_id", "left")
        .withColumn("class", F.coalesce("class", "text_id"))
    )
    joined = settle(joined, "classes")
    keepers = settle(joined.groupBy("class").agg(F.min("least").alias("keeper")), "keepers")
    wordy = joined.join(keepers, "class").select(
        "text_id",
        "keeper",
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts"),
    )
    wordless = signed.where(F.col("signature").isNull() & F.col("text_id").isNotNull()).groupBy("text_id").agg(least.alias("keeper"))
    nothing = F.lit(0).cast("long")
    return wordy.unionByName(wordless.select("text_id", "keeper", nothing.alias("n_links"), nothing.alias("n_linked_texts")))


def link_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links, n_linked_texts) of every row.

    Two documents are linked when the Jaccard similarity of their sets of WORDS-word shingles (words are
    runs of letters and digits, lower case) is at least THRESHOLD. `n_links` counts the other
    documents that a document is linked to, copies each for itself; `n_linked_texts` counts different
    sets once. A class is what links join, directly or over others; its id is its smallest key, NULL keys
    last.

    A text with fewer than WORDS words is one shingle of all of them. A text without words has no shingles and no
    links; exact copies of it are one class. A NULL text has no links and its own key as class. Rows with equal keys count as documents of their own. Other columns
    are not used; an empty table gives no rows. Links found are exact; one is missed with the probability that no band
    agrees (3e-6 at the threshold, less above) or that the pruning errs (TOLERANCE a step).
    """
    signed = settle(sign_texts(documents, key, text), "signatures")
    classes = _text_classes(signed, documents, key, text)
    rows = signed.select("key", "text_id").join(classes, "text_id", "left")
    nothing = F.lit(0).cast("long")
    return rows.select(
        F.col("key").alias(key),
        F.when(F.col("text_id").isNull(), F.col("key")).otherwise(F.col("keeper.key")).alias("class_id"),
        F.coalesce("n_links", nothing).alias("n_links"),
        F.coalesce("n_linked_texts", nothing).alias("n_linked_texts"),
    )


def keep_one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `documents` without near duplicates: of each class the document with the smallest key stays.

    Rows with the same key and text are one document and stay once. Of exact copies of a text without words one
    stays. NULL texts are in no class and stay.
    """
    signed = settle(sign_texts(documents, key, text), "signatures")
    classes = _text_classes(signed, documents, key, text)
    kept = classes.select("keeper").distinct().select(F.col("keeper.key").alias("llm_key"), F.col("keeper.text_hash").alias("llm_hash"))
    alone = signed.where(F.col("text_id").isNull()).select(F.col("key").alias("llm_key"), F.col("text_hash").alias("llm_hash")).distinct()
    kept = kept.unionByName(alone)
    rows = documents.withColumn("llm_text_hash", F.xxhash64(col(text).cast("string")))
    same = col(key).eqNullSafe(F.col("llm_key")) & (F.col("llm_text_hash") == F.col("llm_hash"))
    stay = rows.join(kept, same, "left_semi")
    return stay.dropDuplicates([key, "llm_text_hash"]).drop("llm_text_hash")
