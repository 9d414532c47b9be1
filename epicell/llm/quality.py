"""Text quality by a factorisation machine over hashed words and statistics of the text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.common import col, labelled_sample, map_texts, text_slices

# about so many texts of each label, of at most MAX_CHARS characters, serve the fit
PER_LABEL = 2000
MAX_CHARS = 20_000
WORD_BUCKETS = 1 << 16
FACTORS = 8
ROUNDS = 6
# a small sample is gone over more often, up to so many steps
LEAST_STEPS = 300
BATCH = 64
STEP = 0.1
DECAY = 1e-6
REMEMBERED_WORDS = 500_000

MARKS = "!?.,;:|#$%&*<>{}[]()=/_-\"'"
_MARKS = np.array([ord(m) for m in MARKS])


def _class(byte: int) -> int:
    """Line end, white space, digit, capital, small letter, other ASCII, beyond ASCII."""
    c = chr(byte)
    tests = (c == "\n", c.isspace(), c.isdigit(), "A" <= c <= "Z", "a" <= c <= "z", byte < 128, True)
    return tests.index(True)


CLASSES = 7
_CLASS = np.eye(CLASSES)[[_class(b) for b in range(256)]]
STATISTICS = 8 + CLASSES + len(MARKS)


@dataclass
class Machine:
    """Weights of a factorisation machine; statistics come after the word buckets."""

    constant: float
    linear: np.ndarray  # [WORD_BUCKETS + STATISTICS]
    factors: np.ndarray  # [WORD_BUCKETS + STATISTICS, FACTORS]
    centre: np.ndarray
    scale: np.ndarray
    metadata: tuple[str, ...] = ()

    def score(self, rows: "Inputs") -> np.ndarray:
        """The value of every row in time linear in its features.

        The sum over all pairs <v_i, v_j> x_i x_j is half of (sum v x)^2 - sum (v x)^2, factor by
        factor.
        """
        s, v, w = rows.statistics(self), self.factors, self.linear
        total = rows.by_text(v[rows.bucket] * rows.value[:, None]) + s @ v[WORD_BUCKETS:]
        square = rows.by_text((v**2)[rows.bucket] * (rows.value**2)[:, None]) + s**2 @ v[WORD_BUCKETS:] ** 2
        linear = rows.by_text((w[rows.bucket] * rows.value)[:, None])[:, 0] + s @ w[WORD_BUCKETS:]
        return self.constant + linear + 0.5 * (total**2 - square).sum(axis=1)


@dataclass
class Inputs:
    """Sparse word features of texts (by text, then bucket) and their raw statistics."""

    texts: int
    owner: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    raw: np.ndarray

    def by_text(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.texts, values.shape[1]))
        if len(values):
            starts = np.flatnonzero(np.diff(self.owner, prepend=-1))
            out[self.owner[starts]] = np.add.reduceat(values, starts, axis=0)
        return out

    def statistics(self, m: Machine) -> np.ndarray:
        return np.clip((self.raw - m.centre) / m.scale, -4, 4)

    def some(self, texts: np.ndarray) -> "Inputs":
        """The rows of some texts, in their order."""
        place = np.full(self.texts, -1)
        place[texts] = np.arange(len(texts))
        rows = np.flatnonzero(place[self.owner] >= 0)
        rows = rows[np.argsort(place[self.owner[rows]], kind="stable")]
        return Inputs(len(texts), place[self.owner[rows]], self.bucket[rows], self.value[rows], self.raw[texts])


class Reader:
    """Turns texts into inputs; remembers the buckets of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def read(self, texts: list[str], metadata: list[tuple] | None = None, names: tuple[str, ...] = ()) -> Inputs:
        """`metadata` has the values of the columns `names` of each text; each is one more hashed feature."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {}
        owners, found, raw = [], [], np.zeros((len(texts), STATISTICS))
        for i, text in enumerate(texts):
            words = text.split()
            places = list(map(self.known.get, words))
            if None in places:
                for j, at in enumerate(places):
                    if at is None:
                        word = words[j]
                        places[j] = self.known[word] = zlib.crc32(word.encode()) % WORD_BUCKETS
            owners.append(len(places))
            found += places
            raw[i] = self._statistics(text, words)
        owner = np.repeat(np.arange(len(texts)), owners)
        keys, counts = np.unique(owner * WORD_BUCKETS + np.array(found, dtype=np.int64), return_counts=True)
        owner, bucket = keys // WORD_BUCKETS, keys % WORD_BUCKETS
        value = np.sqrt(counts)
        norm = np.sqrt(np.bincount(owner, counts, len(texts)))
        value = value / norm[owner]
        if names:
            marks = [zlib.crc32(metadata_mark(n, v).encode()) % WORD_BUCKETS for row in metadata for n, v in zip(names, row)]
            owner = np.concatenate([owner, np.repeat(np.arange(len(texts)), len(names))])
            order = np.argsort(owner, kind="stable")
            bucket, value = np.concatenate([bucket, np.array(marks, dtype=np.int64)])[order], np.concatenate([value, np.ones(len(marks))])[order]
            owner = owner[order]
        return Inputs(len(texts), owner, bucket, value, raw)

    @staticmethod
    def _statistics(text: str, words: list[str]) -> list[float]:
        seen = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
        k = max(1, len(words))
        lines = text.split("\n")
        distinct = len(set(words))
        long_lines = [x for x in lines if x]
        return [
            np.log1p(len(text)),
            np.log1p(len(words)),
            np.log1p(len(lines)),
            len(text) / k,
            distinct / k,
            np.log1p(distinct),
            len(set(long_lines)) / max(1, len(long_lines)),
            len(words) / max(1, len(long_lines)),
            *(seen @ _CLASS / max(1, seen.sum())),
            *(seen[_MARKS] / k),
        ]


def metadata_mark(name: str, value: object) -> str:
    """A metadata value as a word that no text has: a number by size, in steps of a fifth; NULL and NaN have a mark of their own."""
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        return f"\n{name}\n{'' if value is None else value}"
    if value != value:
        return f"\n{name}\n"
    step = int(np.sign(value) * np.floor(4 * np.log2(1 + min(abs(float(value)), 1e300))))
    return f"\n{name}\n#{step}"


def fit(rows: list[Row], counts: dict[object, int], seed: int = 11, metadata: tuple[str, ...] = (), values: list[tuple] | None = None) -> Machine | None:
    """A machine from labelled texts, and their metadata, by adaptive gradient steps; None without both labels."""
    if {bool(r["label"]) for r in rows} != {True, False}:
        return None
    reader = Reader()
    every = reader.read([r["text"] for r in rows], values, metadata)
    y = np.array([bool(r["label"]) for r in rows], dtype=float)
    share = {v: sum(n for k, n in counts.items() if bool(k) == v) / (y == v).sum() for v in (True, False)}
    weight = np.where(y > 0, share[True], share[False])
    weight /= weight.mean()
    rng = np.random.default_rng(seed)
    size = WORD_BUCKETS + STATISTICS
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)), every.raw.mean(axis=0), every.raw.std(axis=0) + 1e-6, metadata)
    constant_square, w_square, v_square = 1e-3, np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    tail = slice(WORD_BUCKETS, size)
    for _ in range(max(ROUNDS, -(-LEAST_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            chosen = order[lo : lo + BATCH]
            part = every.some(chosen)
            s, v = part.statistics(m), m.factors
            p = 1 / (1 + np.exp(-np.clip(m.score(part), -30, 30)))
            off = weight[chosen] * (y[chosen] - p) / len(chosen)
            total = part.by_text(v[part.bucket] * part.value[:, None]) + s @ v[WORD_BUCKETS:]
            per_word = off[part.owner] * part.value
            touched, place = np.unique(part.bucket, return_inverse=True)
            g_w = np.bincount(place, per_word, len(touched)) - DECAY * m.linear[touched]
            own = np.bincount(place, per_word * part.value, len(touched))
            g_v = np.stack([np.bincount(place, per_word * total[part.owner, f], len(touched)) for f in range(FACTORS)], axis=1)
            g_v -= own[:, None] * v[touched] + DECAY * v[touched]
            s_w = s.T @ off
            s_v = s.T @ (off[:, None] * total) - (s**2).T @ off[:, None] * v[tail]
            constant_square += off.sum() ** 2
            m.constant += STEP * off.sum() / np.sqrt(constant_square)
            for at, g, square, target in (
                (touched, g_w, w_square, m.linear),
                (touched, g_v, v_square, m.factors),
                (tail, s_w, w_square, m.linear),
                (tail, s_v, v_square, m.factors),
            ):
                square[at] += g**2
                target[at] += STEP * g / np.sqrt(square[at])
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def train(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: Sequence[str] = ()
) -> Machine | None:
    """Fit on a bounded sample (PER_LABEL texts of a label, MAX_CHARS characters) of the labelled texts given.

    The columns `metadata` of the documents are features too: one hashed mark for each value, which meets all
    words and statistics in the pairs; of a key with several rows the least values count. Labels that are NULL, or whose
    text is, are left out.
    """
    rows, counts = labelled_sample(documents, labels, label, PER_LABEL, MAX_CHARS, key, text)
    if not metadata or not rows:
        return fit(rows, counts)
    # as many keys as the sample has
    kinds = T.StructType([T.StructField("llm_key", documents.schema[key].dataType)])
    keys = documents.sparkSession.createDataFrame([(r["key"],) for r in rows], kinds).distinct()
    values = F.struct(*[col(c).alias(f"v{i}") for i, c in enumerate(metadata)])
    held = documents.select(col(key).alias("key"), values.alias("row")).join(F.broadcast(keys), F.col("key") == F.col("llm_key"))
    known = {r["key"]: tuple(r["row"]) for r in held.groupBy("key").agg(F.min("row").alias("row")).collect()}
    return fit(rows, counts, metadata=tuple(metadata), values=[known[r["key"]] for r in rows])


def score_quality(documents: DataFrame, model: Machine | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds `quality_score` (0 to 1) to the columns `keep` of every row.

    Whole texts are read. Features: hashed words; of the text's structure its lines,
    repetition, classes of characters and marks; the metadata columns that the model was trained with, a NULL
    among them being a value of its own. A NULL text counts as an empty one, which has statistics only. Without a
    model (a fit without both labels) every score is 1: nothing is known against a text. Repeated
    rows are scored alike. A column named like the result is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def start():
        machine, reader = shared.value, Reader()

        def step(texts: list[str], metadata: list[tuple] | None = None) -> dict[str, object]:
            if machine is None:
                return {"quality_score": np.ones(len(texts))}
            z = machine.score(reader.read(texts, metadata, machine.metadata))
            return {"quality_score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

        return step

    names = documents.columns if keep is None else keep
    if model is None or not model.metadata:
        return map_texts(documents, text, names, [("quality_score", T.DoubleType())], start)
    return _map_with_metadata(documents, text, [c for c in names if c != "quality_score"], model.metadata, start)


def _map_with_metadata(documents: DataFrame, text: str, kept: Sequence[str], metadata: Sequence[str], start) -> DataFrame:
    """The same over texts and the values of other columns."""
    others = [col(c).alias(f"llm_metadata_{i}") for i, c in enumerate(metadata)]
    source = documents.select(*[col(c) for c in kept], col(text).cast("string").alias("llm_text"), *others)
    schema = T.StructType([documents.schema[c] for c in kept] + [T.StructField("quality_score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            for lo, hi in text_slices(lengths):
                part = batch.slice(lo, hi - lo)
                values = list(zip(*[c.to_pylist() for c in part.columns[at + 1 :]]))
                new = step([t or "" for t in part.column(at).to_pylist()], values)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(new["quality_score"], pa.float64())], schema=arrow)

    return source.mapInArrow(run, schema)


def keep_good(documents: DataFrame, model: Machine | None, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold."""
    return score_quality(documents, model, text=text).where(F.col("quality_score") >= threshold)
