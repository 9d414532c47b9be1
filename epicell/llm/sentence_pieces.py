"""Encoding and decoding with merge-type vocabularies of the sentencepiece library.

The symbols of a stretch of text are its characters. An agenda holds the adjacent pairs that together are a
piece, best score first, of equal scores the leftmost; the first is merged and its new neighbours join the agenda,
until it is empty. Every Arrow batch is checked against the library.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.batch_merge import LONGEST, PairTable, merge_all
from epicell.llm.common import flat_lists, map_texts, text_slices

REMEMBERED_STRETCHES = 600_000
# stands for the end of a text among the stretches, none of which holds a surrogate
END = "\ud800"

# ---- fixed values of the file format: kinds of pieces, and the sign that stands for a blank ----
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BLANK = "▁"
MERGES = 2
# ---- end of fixed values ----


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """The pieces of a vocabulary file: strings, scores and kinds by id, and how text is prepared."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    byte_fallback: bool = False
    dummy_prefix: bool = True
    unknown_surface: str = " ⁇ "
    end: str = "</s>"
    ids: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> "PieceModel":
        """Reads a file. What this encoder does not do (other models than merges, rewriting of characters or of
        white space) is an error."""
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        model = PieceModel([], [], [])
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in message:
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append(piece[1].decode())
                model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                model.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != MERGES or trainer.get(24, 0):
            raise ValueError("not a merge-type vocabulary with blanks before words")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the vocabulary rewrites characters or white space")
        model.byte_fallback = bool(trainer.get(35, 0))
        model.dummy_prefix = bool(normalizer.get(3, 1))
        if 44 in trainer:
            model.unknown_surface = trainer[44].decode()
        model.end = trainer[47].decode() if 47 in trainer else model.end
        model.ids = {p: i for i, p in enumerate(model.pieces)}
        return model

    def of_kind(self, *kinds: int) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k in kinds]

    @property
    def end_id(self) -> int:
        return self.ids[self.end]

    @property
    def unknown_id(self) -> int:
        return self.of_kind(UNKNOWN)[0]


class Agenda:
    """Ids of one stretch of text by merges."""

    def __init__(self, model: PieceModel):
        mergeable = {model.pieces[i]: i for i in model.of_kind(NORMAL, USER_DEFINED, UNUSED)}
        self.ids = {model.pieces[i]: i for i in model.of_kind(NORMAL, USER_DEFINED, BYTE)}
        self.unknown = model.unknown_id
        self.bytes = [model.ids[f"<0x{b:02X}>"] for b in range(256)] if model.byte_fallback else None
        self.frozen = {model.pieces[i] for i in model.of_kind(USER_DEFINED)}
        self.unused = {model.pieces[i] for i in model.of_kind(UNUSED)}
        # symbols are numbers; a pair that is a piece has a rank (0: best score, equal for equal scores) and a result
        self.numbers = {s: n for n, s in enumerate(dict.fromkeys([*mergeable, *(c for p in mergeable for c in p)]))}
        self.strings = list(self.numbers)
        order = {score: rank for rank, score in enumerate(sorted({model.scores[i] for i in mergeable.values()}, reverse=True))}
        self.ranks: dict[int, int] = {}
        self.results: dict[int, int] = {}
        for piece, i in mergeable.items():
            for cut in range(1, len(piece)):
                left, right = self.numbers.get(piece[:cut]), self.numbers.get(piece[cut:])
                if left is not None and right is not None:
                    self.ranks[left << 32 | right] = order[model.scores[i]]
                    self.results[left << 32 | right] = self.numbers[piece]
        # the id of a symbol; -1: not one piece
        self.final = [-1 if s in self.unused else self.ids.get(s, -1) for s in self.strings]
        self.final_of = np.array(self.final, dtype=np.int32)
        pairs = np.array(list(self.ranks), dtype=np.int64)
        ranks, results = (np.array(list(d.values()), dtype=np.int64) for d in (self.ranks, self.results))
        self.table = PairTable(pairs >> 32, pairs & 0xFFFFFFFF, ranks, results)
        self.symbol_of = np.full(0x110000, -1, dtype=np.int32)
        single = {ord(s): n for s, n in self.numbers.items() if len(s) == 1}
        self.symbol_of[list(single)] = list(single.values())

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stretches, end to end, and their numbers. Short ones are merged together, each with an
        agenda of its own."""
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        short = np.flatnonzero(lengths <= LONGEST)
        joined = "".join(texts if len(short) == len(texts) else [texts[i] for i in short])
        symbols = self.symbol_of[np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")]
        left, bounds = merge_all(self.table, symbols, np.concatenate([[0], np.cumsum(lengths[short])]).astype(np.int64))
        ids = np.where(left >= 0, self.final_of[left], -1).astype(np.int32)
        sizes = np.zeros(len(texts), dtype=np.int64)
        sizes[short] = np.diff(bounds)
        # a symbol that is no single id needs a look of its own
        odd = set(short[np.diff(np.concatenate([[0], np.cumsum(ids < 0)])[bounds]) > 0].tolist())
        odd.update(np.flatnonzero(lengths > LONGEST).tolist())
        if self.frozen:
            odd.update(i for i, text in enumerate(texts) if text in self.frozen)
        alone = {i: self.encode(texts[i]) for i in odd}
        if not alone:
            return ids, sizes
        plain = np.ones(len(short), dtype=bool)
        plain[[k for k, i in enumerate(short.tolist()) if i in alone]] = False
        ids = ids[np.repeat(plain, np.diff(bounds))]
        for i, own in alone.items():
            sizes[i] = len(own)
        out = np.zeros(int(sizes.sum()), dtype=np.int32)
        mine = np.ones(len(texts), dtype=bool)
        mine[list(alone)] = False
        out[np.repeat(mine, sizes)] = ids
        ends = np.cumsum(sizes)
        for i, own in alone.items():
            out[ends[i] - sizes[i] : ends[i]] = own
        return out, sizes

    def encode(self, text: str) -> list[int]:
        """Ids of one stretch of any length."""
        if text in self.frozen:
            return [self.ids[text]]
        made: dict[str, tuple[str, str]] = {}
        symbols = self._merge([self.numbers.get(c, -1) for c in text], made)
        out = [self.final[s] if s >= 0 else -1 for s in symbols]
        if -1 not in out:
            return out
        out, at = [], 0
        for s in symbols:
            symbol = text[at] if s < 0 else self.strings[s]
            at += len(symbol)
            self._emit(symbol, made, out)
        return out

    def _note(self, left: int, right: int, result: int, made: dict[str, tuple[str, str]]) -> None:
        """Remember what a piece out of use was made of."""
        if self.strings[result] in self.unused:
            made[self.strings[result]] = (self.strings[left], self.strings[right])

    def _merge(self, symbols: list[int], made: dict[str, tuple[str, str]]) -> list[int]:
        """The agenda is a heap of (rank, place, pair) over a linked list, so that long stretches take n log n."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int]] = []
        find = self.ranks.get

        def offer(left: int, right: int) -> None:
            pair = symbols[left] << 32 | symbols[right]
            rank = find(pair)
            if rank is not None:
                heapq.heappush(agenda, (rank, left, pair))

        gone = [False] * n
        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left]
            # one of the two has been merged into something else since
            if gone[left] or right >= n or symbols[left] << 32 | symbols[right] != pair:
                continue
            new = self.results[pair]
            if self.unused:
                self._note(symbols[left], symbols[right], new, made)
            symbols[left] = new
            gone[right] = True
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [s for s, g in zip(symbols, gone) if not g]

    def _emit(self, symbol: str, made: dict[str, tuple[str, str]], out: list[int]) -> None:
        """The id of a symbol; a piece out of use falls back to what it was made of, a strange one to its bytes."""
        found = self.ids.get(symbol)
        if found is not None:
            out.append(found)
        elif symbol in made:
            for part in made[symbol]:
                self._emit(part, made, out)
        elif self.bytes is not None:
            out += [self.bytes[b] for b in symbol.encode()]
        else:
            out.append(self.unknown)


def stretches(model: PieceModel) -> tuple[re.Pattern, re.Pattern | None]:
    """How a text falls into stretches that no merge crosses, and the strings that are never merged.

    When no piece has a blank sign behind another character, a stretch ends before each blank sign; when no
    piece holds a line feed with something else, a line feed is a stretch. Both are looked up in the vocabulary.
    """
    merged = [model.pieces[i] for i in model.of_kind(NORMAL, UNUSED) if len(model.pieces[i]) > 1]
    lines = not any("\n" in p for p in merged)
    blanks = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in merged)
    rest = "[^\n]" if lines else r"[\s\S]"
    if blanks:
        rest = f"[^{BLANK}\n]" if lines else f"[^{BLANK}]"
        pattern = f"{BLANK}*{rest}+|{BLANK}+"
    else:
        pattern = f"{rest}+"
    frozen = sorted((model.pieces[i] for i in model.of_kind(USER_DEFINED)), key=len, reverse=True)
    return re.compile(pattern + ("|\n" if lines else "")), re.compile("(" + "|".join(map(re.escape, frozen)) + ")") if frozen else None


class PieceEncoder:
    """Ids of texts; remembers the stretches that it has met."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.agenda = Agenda(model)
        split, self.frozen = stretches(model)
        self.split = split.findall
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, dtype=np.int32)
        self.starts = np.zeros(1 << 17, dtype=np.int64)
        self._keep([END], np.array([model.end_id]), np.array([1]))

    def _learn(self, stretches: list[str]) -> None:
        ids, sizes = self.agenda.encode_all(stretches)
        self._keep(stretches, ids, sizes)

    def _keep(self, stretches: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        at = self.starts[n]
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[at : at + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.known.update(zip(stretches, range(n, n + len(sizes))))

    def _trim(self) -> None:
        """Forget the later half: what was met first is met most."""
        self.known = dict(islice(self.known.items(), len(self.known) // 2))

    def prepared(self, text: str) -> str:
        if not text:
            return ""
        return (BLANK if self.model.dummy_prefix else "") + text.replace(" ", BLANK)

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where each begins."""
        if len(self.known) > REMEMBERED_STRETCHES:
            self._trim()
        parts: list[str] = []
        bounds = [0]
        for text in texts:
            ready = self.prepared(text)
            if self.frozen is None:
                parts += self.split(ready)
            else:
                parts += [s for i, p in enumerate(self.frozen.split(ready)) for s in ([p] if i % 2 else self.split(p))]
            if end:
                parts.append(END)
            bounds.append(len(parts))
        found = list(map(self.known.get, parts))
        if None in found:
            # what is new in all texts is learnt together
            self._learn(list(dict.fromkeys(p for p, place in zip(parts, found) if place is None)))
            found = list(map(self.known.get, parts))
        at = np.array(found, dtype=np.int64)
        begin = self.starts[at]
        lengths = self.starts[at + 1] - begin
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        within = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], lengths)
        return self.flat[within], ends[bounds]


class PieceDecoder:
    """Texts of ids, all rows of a batch in one gather."""

    def __init__(self, model: PieceModel):
        kinds = np.array(model.kinds)
        surfaces = []
        for piece, kind in zip(model.pieces, model.kinds):
            if kind == CONTROL:
                surfaces.append(b"")
            elif kind == UNKNOWN:
                surfaces.append(model.unknown_surface.encode())
            elif kind == BYTE:
                surfaces.append(bytes([int(piece[1:-1], 16)]))
            else:
                surfaces.append(piece.replace(BLANK, " ").encode())
        lengths = np.array([len(s) for s in surfaces], dtype=np.int64)
        self.stop = np.cumsum(lengths)
        self.begin = self.stop - lengths
        self.flat = np.frombuffer(b"".join(surfaces), dtype=np.uint8)
        self.silent = kinds == CONTROL
        self.is_byte = kinds == BYTE
        # what gives up its first blank at the beginning of a text
        opens = [k not in (CONTROL, UNKNOWN, BYTE) and p.startswith(BLANK) for p, k in zip(model.pieces, model.kinds)]
        self.opens = np.array(opens) & model.dummy_prefix

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        rows = len(bounds) - 1
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.silent)):
            raise ValueError("an id outside the vocabulary")
        begin, stop = self.begin[ids], self.stop[ids].copy()
        heard = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(heard, bounds[:-1])
        if len(heard):
            first = heard[np.minimum(first, len(heard) - 1)]
            first = np.unique(first[(first >= bounds[:-1]) & (first < bounds[1:])])
            begin = begin.copy()
            begin[first[self.opens[ids[first]]]] += 1
        lengths = stop - begin
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        data = self.flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], lengths)] if ends[-1] else np.zeros(0, dtype=np.uint8)
        offsets = ends[bounds]
        texts = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        try:
            texts.validate(full=True)
            return texts
        except pa.ArrowInvalid:
            raw = data.tobytes()
            pieces = zip(bounds[:-1].tolist(), bounds[1:].tolist())
            return pa.array([self._repair(raw, ids, ends, a, b) for a, b in pieces], pa.large_string())

    def _repair(self, raw: bytes, ids: np.ndarray, ends: np.ndarray, first: int, last: int) -> str:
        """A row in which byte pieces are no UTF-8: each byte that begins no character becomes U+FFFD."""
        out: list[str] = []
        at = first
        while at < last:
            stop = at + 1
            own = bool(self.is_byte[ids[at]])
            while stop < last and bool(self.is_byte[ids[stop]]) == own:
                stop += 1
            part = raw[ends[at] : ends[stop]]
            while part:
                try:
                    out.append(part.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(part[: e.start].decode() + "�")
                    part = part[e.start + 1 :]
            at = stop
        return "".join(out)


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker: what it remembers serves the next task too."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(PieceModel.load(path))
    return _encoders[path]


def encode(
    documents: DataFrame, model: str, keep: list[str] | None = None, text: str = "text", end: bool = True, checked: bool = True
) -> DataFrame:
    """Adds `ids` (array of int) to the columns `keep` of every row: those that the sentencepiece library gives for
    the vocabulary file `model` without sampling, and with the end id if `end`.

    If `checked`, the library encodes each Arrow batch as well, and a difference is an error. The file is
    opened on the executors. A NULL or empty text has the end id alone. Repeated rows are encoded alike. A column named
    `ids` is replaced.
    """

    def start():
        encoder = piece_encoder(model)
        library = _library(model) if checked else None

        def step(texts: list[str]) -> dict[str, object]:
            ids, bounds = encoder.encode(texts, end)
            if library is not None:
                _compare(library, texts, ids, bounds, end)
            return {"ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))}

        return step

    names = documents.columns if keep is None else keep
    return map_texts(documents, text, names, [("ids", T.ArrayType(T.IntegerType()))], start)


def _library(model: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)


def _compare(library, texts: list[str], ids: np.ndarray, bounds: np.ndarray, end: bool) -> None:
    theirs = library.encode(texts, add_bos=False, add_eos=end, num_threads=1)
    sizes = np.fromiter(map(len, theirs), dtype=np.int64, count=len(theirs))
    if np.array_equal(sizes, np.diff(bounds)):
        same = np.array([i for row in theirs for i in row], dtype=np.int32)
        if np.array_equal(same, ids):
            return
    for text, row, a, b in zip(texts, theirs, bounds.tolist(), bounds[1:].tolist()):
        if row != ids[a:b].tolist():
            raise ValueError(f"other ids than the library's for the text that begins {text[:80]!r}")


def decode(encoded: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of the ids, as the library decodes them.

    Control pieces are silent, an unknown one is written as the file says, the first blank of the text goes
    if the encoder puts one before. Bytes that are no UTF-8 become U+FFFD one by one. No ids, or NULL, is the
    empty text; a NULL id is left out; an id outside the vocabulary is an error. A column called `name` is replaced.
    """
    source = encoded.drop(name) if name in encoded.columns and name != ids else encoded
    schema = T.StructType([*source.schema.fields, T.StructField(name, T.StringType())])
    arrow = to_arrow_schema(schema)
    at = source.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = PieceDecoder(PieceModel.load(model))
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()
            for lo, hi in text_slices(sizes):
                part = batch.slice(lo, hi - lo)
                values, bounds = flat_lists(part.column(at))
                texts = decoder.decode(values, bounds).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], schema=arrow)

    return source.mapInArrow(run, schema)
