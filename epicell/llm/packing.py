"""Bounded-space online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.bpe import Vocabulary
from epicell.llm.common import col, forgotten_between_jobs, text_slices
from epicell.session import settle

WINDOW = 4096
OPEN_WINDOWS = 64
# a gap of at least so many tokens is filled with the head of the next piece
MIN_CUT = 64
# leftover windows that one merging task takes
MERGE_WINDOWS = 1024
REMEMBERED_CHUNKS = 500_000

# characters whose normal form, white space or lower case is more than a look at themselves
ODD = re.compile("[\x1c-\x1f\x85İ]|[^\x00-\u02ff]")
ODD_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f")
# fixed value of the format: how text without white space is split before any merge
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


class WordEncoder:
    """Ids of whole texts by a tokenizer of lower-case words that never cross white space.

    A chunk between white space is split and merged once and then remembered. A text with an
    odd character, or with the opening of a special token, is given to the tokenizers library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = Vocabulary.load(path)
        self.split = regex.compile(SPLIT).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 17, dtype=np.int64)

    def _trim(self) -> None:
        """Forget the later half: what was met first is met most."""
        self.known = dict(islice(self.known.items(), len(self.known) // 2))

    def _learn(self, chunks: list[str]) -> None:
        """Chunks that are new are split, their distinct words merged together, and all remembered."""
        split = list(map(self.split, chunks))
        flat = list(chain.from_iterable(split))
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        ids, sizes = self.vocabulary.merge_words([w.encode() for w in number])
        begin = np.cumsum(sizes) - sizes
        at = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        new = ids[np.arange(ends[-1]) + np.repeat(begin[at] - ends[:-1], lengths)]
        cuts = ends[np.cumsum([0, *map(len, split)])]
        n, first = len(self.known), self.starts[len(self.known)]
        while first + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(chunks) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[first : first + len(new)] = new
        self.starts[n + 1 : n + 1 + len(chunks)] = first + cuts[1:]
        self.known.update(zip(chunks, range(n, n + len(chunks))))

    @staticmethod
    def plain(text: str) -> bool:
        odd = any(c in text for c in ODD_ASCII) if text.isascii() else ODD.search(text) is not None
        return not odd and "<|" not in text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED_CHUNKS:
            self._trim()
        chunks: list[str] = []
        bounds, out = [0], {}
        for i, text in enumerate(texts):
            if self.plain(text):
                chunks += text.lower().split()
            else:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            bounds.append(len(chunks))
        places = list(map(self.known.get, chunks))
        if None in places:
            self._learn(list(dict.fromkeys(c for c, place in zip(chunks, places) if place is None)))
            places = list(map(self.known.get, chunks))
        at = np.array(places, dtype=np.int64)
        begin = self.starts[at]
        lengths = self.starts[at + 1] - begin
        ends = np.cumsum(lengths)
        ids = np.zeros(0, dtype=np.uint32)
        if len(ends) and ends[-1]:
            ids = self.flat[np.arange(ends[-1]) + np.repeat(begin - (ends - lengths), lengths)]
        cuts = np.concatenate([[0], ends])[bounds].tolist()
        return [out[i] if i in out else ids[lo:hi] for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]


_encoders: dict[str, WordEncoder] = {}
forgotten_between_jobs.append(_encoders.clear)


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker: what it remembers serves the next task too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@dataclass
class Piece:
    key: object
    start: int
    doc_tokens: int
    ids: np.ndarray


@dataclass
class Window:
    pieces: list[Piece] = field(default_factory=list)
    used: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece.ids)


def cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    head = Piece(piece.key, piece.start, piece.doc_tokens, piece.ids[:at])
    return head, Piece(piece.key, piece.start + at, piece.doc_tokens, piece.ids[at:])


class OpenWindows:
    """At most `most` open windows: best fit, else the fullest is completed or emitted."""

    def __init__(self, window: int, most: int, min_cut: int):
        self.window, self.most, self.min_cut = window, most, min_cut
        self.gaps: list[int] = []  # ascending, with `open` in the same order
        self.open: list[Window] = []

    def _keep(self, w: Window) -> None:
        gap = self.window - w.used
        at = bisect.bisect_left(self.gaps, gap)
        self.gaps.insert(at, gap)
        self.open.insert(at, w)

    def place(self, piece: Piece) -> Iterator[Window]:
        while len(piece.ids) >= self.window:
            head, piece = cut(piece, self.window)
            yield Window([head], self.window)
        while len(piece.ids):
            at = bisect.bisect_left(self.gaps, len(piece.ids))
            if at < len(self.gaps):
                w = self.open.pop(at)
                self.gaps.pop(at)
                w.add(piece)
                if w.used == self.window:
                    yield w
                else:
                    self._keep(w)
                return
            if len(self.open) < self.most:
                self._keep(Window([piece], len(piece.ids)))
                return
            fullest, gap = self.open.pop(0), self.gaps.pop(0)
            if gap >= self.min_cut:
                head, piece = cut(piece, gap)
                fullest.add(head)
            yield fullest

    def rest(self) -> list[Window]:
        return self.open


def fill(pieces: Iterator[Piece], window: int) -> Iterator[Window]:
    """Windows filled to the last token, cutting pieces; the last one may be short."""
    w = Window()
    for piece in pieces:
        while len(piece.ids):
            head, piece = cut(piece, window - w.used) if len(piece.ids) > window - w.used else (piece, Piece(None, 0, 0, piece.ids[:0]))
            w.add(head)
            if w.used == window:
                yield w
                w = Window()
    if w.used:
        yield w


def powers(w: Window) -> Iterator[Window]:
    """The content of a short window cut to lengths that are powers of two, which need no padding."""
    pieces = list(w.pieces)
    left = w.used
    while left:
        size = 1 << (left.bit_length() - 1)
        part = next(fill(iter(pieces), size))
        taken, rest = size, []
        for piece in pieces:
            n = min(taken, len(piece.ids))
            taken -= n
            if n < len(piece.ids):
                rest.append(cut(piece, n)[1])
        yield part
        pieces, left = rest, left - size


def _schema(key: T.DataType) -> T.StructType:
    piece = T.StructType(
        [
            T.StructField("doc", key),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    return T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("whole", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("pieces", T.ArrayType(piece)),
            T.StructField("ids", T.BinaryType()),
        ]
    )


class _Rows:
    """Collects windows as rows of the result; ids are numbered within (round, task)."""

    def __init__(self, schema: pa.Schema, round_no: int):
        self.schema = schema
        self.next_id = (round_no << 58) | (TaskContext.get().partitionId() << 24)
        self.windows: list[tuple[int, bool, Window]] = []

    def add(self, w: Window, whole: bool) -> None:
        self.windows.append((self.next_id, whole, w))
        self.next_id += 1

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.windows) < least:
            return
        numbers, whole, windows = zip(*self.windows)
        pieces = [p for w in windows for p in w.pieces]
        lengths = np.array([len(p.ids) for p in pieces], dtype=np.int64)
        bounds = np.cumsum([0, *[len(w.pieces) for w in windows]])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        offsets = ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds))
        item = self.schema.field("pieces").type.value_type
        columns = [pa.array([p.key for p in pieces], item.field(0).type), np.array([p.start for p in pieces], dtype=np.int64), lengths]
        columns += [np.array([p.doc_tokens for p in pieces], dtype=np.int64), offsets]
        rows = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], fields=list(item))
        ids = np.concatenate([p.ids for p in pieces]).astype("<u4")
        cuts = (4 * ends[bounds]).astype(np.int32)
        arrays = [
            pa.array(numbers, pa.int64()),
            pa.array(whole),
            pa.array(np.diff(ends[bounds])),
            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows, type=self.schema.field("pieces").type),
            pa.BinaryArray.from_buffers(pa.binary(), len(windows), [None, pa.py_buffer(cuts), pa.py_buffer(ids)]),
        ]
        self.windows = []
        yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def pack(
    documents: DataFrame,
    vocabulary: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
) -> DataFrame:
    """Sequences of at most `window` token ids: (sequence_id, n_tokens, pieces, ids).

    `pieces` are structs (doc, start, length, doc_tokens, offset) without gaps, `ids` is the
    little-endian unsigned 32-bit ids of the sequence. A document is its ids by the tokenizer file
    `vocabulary` and `end_id`.

    Each partition keeps `open_windows` windows. A piece goes to the window with the smallest gap
    that holds it; when none does, the fullest is completed with the head of the piece (a gap under
    `min_cut` stays) and emitted. What is open at the end of a partition is merged afterwards:
    tasks of MERGE_WINDOWS leftovers fill windows to the last token and leave one short window
    each, round after round, until one task has them all; its last window is cut into powers of
    two. So memory is bounded in every task, and no step but the last few thousand leftovers meets
    in one place.

    A NULL or empty text is the document of `end_id` alone. Documents with equal or NULL keys are
    packed each for itself. Other columns are not used. An empty table gives no sequence.
    """
    kind = documents.schema[key].dataType
    schema = _schema(kind)
    arrow = to_arrow_schema(schema)
    source = documents.select(col(key).alias("doc"), col(text).cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        bins, rows = OpenWindows(window, open_windows, min_cut), _Rows(arrow, 0)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for lo, hi in text_slices(sizes):
                part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                keys = batch.column(0).slice(lo, hi - lo).to_pylist()
                for k, ids in zip(keys, encoder.encode(part)):
                    ids = np.concatenate([ids, end])
                    for w in bins.place(Piece(k, 0, len(ids), ids)):
                        rows.add(w, True)
                yield from rows.take(64)
        for w in bins.rest():
            rows.add(w, False)
        yield from rows.take()

    def merge(round_no: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _Rows(arrow, round_no)

            def pieces() -> Iterator[Piece]:
                for batch in batches:
                    for row in batch.to_pylist():
                        ids = np.frombuffer(row["ids"], dtype="<u4")
                        for p in row["pieces"]:
                            yield Piece(p["doc"], p["start"], p["doc_tokens"], ids[p["offset"] : p["offset"] + p["length"]])

            for w in fill(pieces(), window):
                if w.used == window:
                    rows.add(w, True)
                else:
                    for part in powers(w) if last else [w]:
                        rows.add(part, last)
                yield from rows.take(64)
            yield from rows.take()

        return run

    done = []
    packed = settle(source.mapInArrow(first, schema), "packed")
    for round_no in range(1, 32):
        done.append(packed.where("whole"))
        left = packed.where("NOT whole")
        n = left.count()
        if not n:
            break
        tasks = -(-n // MERGE_WINDOWS)
        dealt = left.repartition(tasks, "sequence_id") if tasks > 1 else left.coalesce(1)
        packed = settle(dealt.mapInArrow(merge(round_no, tasks == 1), schema), "packed")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("sequence_id", "n_tokens", "pieces", "ids")


def piece_digests(sequences: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per piece, with the crc32 of its ids in place of the ids. Documents with NULL or equal keys keep their
    own pieces; without sequences there are no rows."""
    piece = F.transform(
        "pieces",
        lambda p: F.struct(
            p["doc"].alias(key),
            p["start"].alias("start"),
            p["length"].alias("length"),
            F.crc32(
                F.substr(F.col("ids"), (p["offset"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int"))
            ).alias("ids_crc32"),
            p["doc_tokens"].alias("doc_tokens"),
            F.col("sequence_id").alias("sequence_id"),
            p["offset"].alias("offset"),
        ),
    )
    return sequences.select(F.inline(piece))
