"""Helpers that several corpus operators share: text batches, label splits, bounded samples."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Python works on so many characters at a time; a longer text is a batch of its own
BATCH_CHARS = 2_000_000


# what a Python worker forgets when it turns to another job: functions that empty memories kept for later tasks
forgotten_between_jobs: list[Callable[[], None]] = []


def turn_to_another_job() -> None:
    for forget in forgotten_between_jobs:
        forget()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for an application, as `--py-files` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="epicell-"), "epicell_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "epicell")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; NULL for a NULL key."""
    return F.pmod(F.crc32(col(key).cast("string").cast("binary")), F.lit(parts))


def text_slices(sizes: Sequence[int], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` characters together, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    start: Callable[[], Callable[[list[str]], dict[str, object]]],
) -> DataFrame:
    """The columns `keep` of every row, and `fields` computed from its whole text.

    `start` runs once in a task and returns the function that takes a list of texts (NULL: empty)
    and returns one array for each field. A field replaces a kept column of the same name.
    """
    names = [name for name, _ in fields]
    kept = [c for c in keep if c not in names]
    own = text in kept
    source = df.select(*[col(c) for c in kept], *([] if own else [col(text).alias("llm_text")]))
    at = kept.index(text) if own else len(kept)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to_another_job()
        step = start()
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for lo, hi in text_slices(lengths):
                part = batch.slice(lo, hi - lo)
                new = step([t or "" for t in part.column(at).to_pylist()])
                columns = [part.column(i) for i in range(len(kept))]
                columns += [pa.array(new[n], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema)


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column, and where each row begins; NULL numbers are left out."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    values = lists.flatten()
    if values.null_count:
        present = values.is_valid().to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(present)])[bounds]
        values = values.drop_null()
    return values.to_numpy(zero_copy_only=False), bounds


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    per_label: int,
    max_chars: int,
    key: str = "doc_id",
    text: str = "text",
) -> tuple[list[Row], dict[object, int]]:
    """A bounded sample of labelled texts for a fit, and the number of labelled keys of each label.

    Of each label about `per_label` keys, 2 * per_label at most, evenly by a hash of the key, with
    texts of at most `max_chars` characters. The sampled keys are a table of bounded size, so it is broadcast
    to the scan of the documents. Of the texts of a key the least is taken, before anything goes to the driver.
    """
    known = labels.where(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key)).agg(F.max(col(label)).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for value, n in sorted(counts.items()):
        part = F.pmod(F.xxhash64(col(key)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, per_label / n)) + 1
        rows = known.where((F.col("label") == value) & part).limit(2 * per_label)
        chosen = rows if chosen is None else chosen.unionByName(rows)
    if chosen is None:
        return [], {}
    texts = documents.select(col(key), col(text).alias("text")).where(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(chosen), key).select(col(key).alias("key"), "text", "label")
    rows = found.groupBy("key", "label").agg(F.min("text").alias("text")).select("key", "text", "label").collect()
    return sorted(rows, key=lambda r: (str(r["key"]), r["text"])), counts
