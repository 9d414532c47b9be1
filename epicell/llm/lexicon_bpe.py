"""Byte-pair encoding through a lexicon of frequent words, and decoding.

Frequent words, with the ids they encode to, are compiled into a minimal acyclic transducer: an automaton that shares
prefixes and suffixes, whose arcs carry numbers that add up to the number of the word. It is one
block of bytes, which every task maps into memory. Any other word is merged pair by pair, exactly.
"""

from __future__ import annotations

import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.bpe import Vocabulary
from epicell.llm.common import col, flat_lists, map_texts, text_slices
from epicell.operators.order_stats import RANGE_BITS, value_key
from epicell.session import settle

# the lexicon holds so many of the commonest words; its size does not depend on the corpus
LEXICON_WORDS = 50_000
# a task hands on its counts whenever it has so many different pieces
COUNTED_PIECES = 400_000
REMEMBERED_PIECES = 300_000

# fixed value of the format: how text is split before any merge
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# white space before a blank is the only thing that lets a word depend on more than its piece
ODD_BLANKS = re.compile("[\x1c-\x1f\x85\xa0  -     　] ")
# the classes of nearer characters are the same in all Unicode versions
FAR = re.compile("[^\x00-\u02ff]")
BLANKS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")


class Automaton:
    """A minimal acyclic automaton over bytes whose arc numbers add up to the number of the word.

    Arcs lie in one array; the arcs of a state start at its base, at the place of their byte, and
    states are laid into each other's gaps.
    """

    MAGIC = 0x45504C58

    def __init__(self, base, owner, target, output, final):
        self.base, self.owner, self.target, self.output, self.final = base, owner, target, output, final

    @staticmethod
    def compile(words: list[bytes]) -> "Automaton":
        """From sorted distinct words: finished branches are merged with equal ones as soon as they end."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # parent, byte, child of the last word, not yet merged

        def close(depth: int) -> None:
            while len(path) > depth:
                parent, byte, child = path.pop()
                signature = (final[child], tuple(arcs[child].items()))
                arcs[parent][byte] = register.setdefault(signature, child)

        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            state = path[-1][2] if path else 0
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[state][byte] = len(arcs) - 1
                path.append((state, byte, len(arcs) - 1))
                state = len(arcs) - 1
            final[state] = True
            last = word
        close(0)
        # keep what is reached, children before parents, to count the words under each state
        order, seen, stack = [], set(), [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                order.append(state)
            elif state not in seen:
                seen.add(state)
                stack.append((state, True))
                stack += [(t, False) for t in arcs[state].values()]
        number = {s: i for i, s in enumerate(reversed(order))}
        under: dict[int, int] = {}
        for state in order:
            under[state] = final[state] + sum(under[t] for t in arcs[state].values())
        n = len(order)
        base = np.zeros(n, dtype=np.int32)
        used = np.zeros(1024, dtype=bool)
        filled = sorted((s for s in order if arcs[s]), key=lambda s: (-len(arcs[s]), number[s]))
        free = 0
        for state in filled:
            labels = sorted(arcs[state])
            at = max(0, free - labels[0])
            while True:
                if len(used) < at + 4096 + 512:
                    used = np.concatenate([used, np.zeros(len(used) + 8192, dtype=bool)])
                fits = ~used[at + labels[0] : at + labels[0] + 4096]
                for b in labels[1:]:
                    fits &= ~used[at + b : at + b + 4096]
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += 4096
            base[number[state]] = at
            used[[at + b for b in labels]] = True
            if len(labels) == 1:
                free = at + labels[0]
        size = int(np.flatnonzero(used)[-1]) + 257 if filled else 257
        owner = np.full(size, -1, dtype=np.int32)
        target, output = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for state in filled:
            before = int(final[state])
            for byte, t in sorted(arcs[state].items()):
                slot = base[number[state]] + byte
                owner[slot], target[slot], output[slot] = number[state], number[t], before
                before += under[t]
        flags = np.array([final[s] for s in reversed(order)], dtype=np.int32)
        return Automaton(base, owner, target, output, flags)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that is not in the lexicon; all words walk at once."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        found = np.full(len(words), -1, dtype=np.int64)
        alive = np.arange(len(words))
        state = np.zeros(len(words), dtype=np.int32)
        total = np.zeros(len(words), dtype=np.int64)
        step = 0
        while len(alive):
            ended = lengths[alive] == step
            if ended.any():
                good = ended & (self.final[state] == 1)
                found[alive[good]] = total[good]
                alive, state, total = alive[~ended], state[~ended], total[~ended]
            slot = self.base[state] + flat[starts[alive] + step]
            ok = self.owner[slot] == state
            alive, slot = alive[ok], slot[ok]
            state, total = self.target[slot], total[ok] + self.output[slot]
            step += 1
        return found


class Lexicon:
    """An automaton with the ids of its words, in one block of bytes."""

    def __init__(self, automaton: Automaton, starts: np.ndarray, ids: np.ndarray):
        self.automaton, self.starts, self.ids = automaton, starts, ids

    @staticmethod
    def compile(words: Iterable[str], vocabulary: Vocabulary) -> bytes:
        keys = sorted({w.encode() for w in words} - {b""})
        a = Automaton.compile(keys)
        outputs = [vocabulary.merge(k) for k in keys]
        starts = np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int32)
        ids = np.array([i for o in outputs for i in o], dtype=np.int32)
        parts = [x.astype("<i4") for x in (a.base, a.owner, a.target, a.output, a.final, starts, ids)]
        head = np.array([Automaton.MAGIC, *[len(x) for x in parts]], dtype="<i4")
        return b"".join(x.tobytes() for x in (head, *parts))

    @staticmethod
    def over(block) -> "Lexicon":
        head = np.frombuffer(block, dtype="<i4", count=8)
        if head[0] != Automaton.MAGIC:
            raise ValueError("not a lexicon")
        parts, at = [], 8
        for n in head[1:]:
            parts.append(np.frombuffer(block, dtype="<i4", count=int(n), offset=4 * at))
            at += int(n)
        return Lexicon(Automaton(*parts[:5]), parts[5], parts[6])

    @staticmethod
    def mapped(block: bytes) -> "Lexicon":
        """The block as a file of this worker, mapped into memory; the file has no name and ends with it."""
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            return Lexicon.over(mmap.mmap(file.fileno(), len(block), access=mmap.ACCESS_READ))


def splits_by_blank(text: str) -> bool:
    """True when the words of a text are those of its pieces between blanks, each with the blank before it."""
    return not (any(b in text for b in BLANKS) or ODD_BLANKS.search(text))


@lru_cache
def unsettled_characters() -> dict[int, str]:
    """Stand-ins for the characters whose class differs between regex and the tokenizers library.

    The two follow different Unicode versions, so the library is asked about every character on which
    regex and Python's tables differ. A stand-in has the class that the library sees.
    """
    from tokenizers import pre_tokenizers

    asked = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    letters, numbers = set(regex.findall(r"\p{L}", every)), set(regex.findall(r"\p{N}", every))
    out = {}
    for c in every:
        here = "a" if c in letters else "1" if c in numbers else "!"
        kind = unicodedata.category(c)
        if here != {"L": "a", "N": "1"}.get(kind[0], "!") or kind == "Cn" and here != "!":
            there = next((x for x in "a1" if len(asked(x + c)) == 1), "!")
            if there != here:
                out[ord(c)] = there
    return out


class Splitter:
    """Words of a text, as the tokenizer splits it. Made on the driver and sent along."""

    def __init__(self, special: Iterable[str]):
        self.split = regex.compile(SPLIT)
        escaped = "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))
        self.special = re.compile(f"({escaped})") if escaped else None
        self.marks = tuple(special)
        self.stand_ins = unsettled_characters()
        self.unsettled = frozenset(map(chr, self.stand_ins))

    def words(self, text: str) -> list[str]:
        if text.isascii() or not FAR.search(text) or self.unsettled.isdisjoint(text):
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(text.translate(self.stand_ins))]

    def parts(self, text: str) -> list[str]:
        """Ordinary and special stretches; the special ones are at odd places."""
        if self.special is None or not any(m in text for m in self.marks):
            return [text]
        return self.special.split(text)


def spread(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places begin[i], begin[i] + 1, ... for each i, lengths[i] of them."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - lengths), lengths)


class Encoder:
    """Ids of texts; remembers the pieces that it has met."""

    def __init__(self, lexicon: Lexicon, vocabulary: Vocabulary, splitter: Splitter):
        self.lexicon, self.vocabulary, self.splitter = lexicon, vocabulary, splitter
        self.pieces: dict[str, int] = {}  # after a blank
        self.words: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, dtype=np.int32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.count = 0

    def _trim(self) -> None:
        """Forget the later half: what was met first is met most."""
        self.count //= 2
        self.pieces = {p: at for p, at in self.pieces.items() if at < self.count}
        self.words = {w: at for w, at in self.words.items() if at < self.count}

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Remember the ids of new pieces or words, and give their places."""
        first, n = self.count, len(sizes)
        begin = self.starts[first]
        while begin + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[begin : begin + len(ids)] = ids
        self.starts[first + 1 : first + n + 1] = begin + np.cumsum(sizes)
        self.count += n
        return range(first, self.count)

    def _resolve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and their numbers: the automaton's, or else merged."""
        coded = [w.encode() for w in words]
        number = self.lexicon.automaton.find(coded)
        known = number >= 0
        ids, sizes = self.vocabulary.merge_words([w for w, k in zip(coded, known.tolist()) if not k])
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[~known] = sizes
        begin, end = self.lexicon.starts[number[known]], self.lexicon.starts[number[known] + 1]
        lengths[known] = end - begin
        out = np.empty(int(lengths.sum()), dtype=np.int32)
        of_lexicon = np.repeat(known, lengths)
        out[~of_lexicon] = ids
        out[of_lexicon] = self.lexicon.ids[spread(begin.astype(np.int64), lengths[known])]
        return out, lengths

    def _learn_words(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if new:
            self.words.update(zip(new, self._keep(*self._resolve(new))))

    def _learn_pieces(self, pieces: list[str]) -> None:
        split = [self.splitter.words(" " + p) for p in pieces]
        flat = list(chain.from_iterable(split))
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        ids, sizes = self._resolve(list(number))
        begin = np.cumsum(sizes) - sizes
        at = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, split)])]
        self.pieces.update(zip(pieces, self._keep(ids[spread(begin[at], lengths)], np.diff(ends))))

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        """Words at the head of an ordinary stretch, and the pieces after each blank."""
        if not text:
            return [], []
        if splits_by_blank(text):
            text, *pieces = text.split(" ")
            return self.splitter.words(text), pieces
        return self.splitter.words(text), []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each begins."""
        if self.count > REMEMBERED_PIECES:
            self._trim()
        split = [self.splitter.parts(text) for text in texts]
        cut = [[self._cut(part) for part in parts[::2]] for parts in split]
        # what is new in all texts is learnt at once: all its words then walk the automaton together
        self._learn_words(w for parts in cut for words, _ in parts for w in words)
        new: set[str] = set()
        for parts in cut:
            for _, pieces in parts:
                new.update(pieces)
        new -= self.pieces.keys()
        if new:
            self._learn_pieces(sorted(new))
        places, sizes = [], []
        word_place, piece_place = self.words.__getitem__, self.pieces.__getitem__
        for parts, stretches in zip(split, cut):
            before = len(places)
            for k, (words, pieces) in enumerate(stretches):
                if k:
                    places.append(-1 - self.vocabulary.special[parts[2 * k - 1]])
                places += map(word_place, words)
                places += map(piece_place, pieces)
            sizes.append(len(places) - before)
        at = np.array(places, dtype=np.int64)
        special = at < 0
        begin = np.where(special, 0, self.starts[np.where(special, 0, at)])
        lengths = np.where(special, 1, self.starts[np.where(special, 0, at) + 1] - begin)
        ends = np.cumsum(lengths)
        ids = self.flat[spread(begin, lengths)]
        if special.any():
            ids[(ends - 1)[special]] = -1 - at[special]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return ids, bounds


def word_counts(documents: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """(word, n) over all texts. Tasks count pieces first, so a frequent word is a row per task; pieces are split
    into words when they have been added up, once for all tasks."""
    counted = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    marked = T.StructType([*counted.fields, T.StructField("is_piece", T.BooleanType())])
    arrow, marked_arrow = to_arrow_schema(counted), to_arrow_schema(marked)
    splitter = Splitter(vocabulary.special)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Counter = Counter()
        words: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for found, is_piece in ((pieces, True), (words, False)):
                if found:
                    columns = [pa.array(list(found)), pa.array(list(found.values()), pa.int64()), pa.array([is_piece] * len(found))]
                    yield pa.RecordBatch.from_arrays(columns, schema=marked_arrow)
                found.clear()

        for batch in batches:
            for value in batch.column(0):
                for part in splitter.parts(value.as_py() or "")[::2]:
                    if splits_by_blank(part):
                        part, *rest = part.split(" ")
                        pieces.update(rest)
                    words.update(splitter.words(part))
                if len(pieces) + len(words) > COUNTED_PIECES:
                    yield from flush()
        yield from flush()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for found, n, is_piece in zip(*(c.to_pylist() for c in batch.columns)):
                for word in splitter.words(" " + found) if is_piece else (found,):
                    words[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], schema=arrow)

    source = documents.select(col(text).cast("string").alias("text"))
    pieces = source.mapInArrow(count, marked).groupBy("word", "is_piece").agg(F.sum("n").alias("n")).select("word", "n", "is_piece")
    return pieces.mapInArrow(split, counted).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, vocabulary: Vocabulary, text: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the commonest words of all texts, `size` at most.

    Words are counted by ranges of their number first (up to 256 by single numbers; there are a few thousand
    ranges), so that only the words of the lexicon come to the driver: those of all ranges that fit.
    """
    counts = settle(word_counts(documents, vocabulary, text), "words")
    ranged = counts.withColumn("range", F.shiftright(value_key(F.col("n").cast("double")), RANGE_BITS[0]))
    words, lowest = 0, None
    for row in sorted(ranged.groupBy("range").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["range"]):
        words += row["words"]
        if words > size:
            break
        lowest = row["range"]
    if lowest is None:
        return Lexicon.compile([], vocabulary)
    return Lexicon.compile([r["word"] for r in ranged.where(F.col("range") >= lowest).select("word").collect()], vocabulary)


_encoders: dict[bytes, Encoder] = {}


def worker_encoder(block: bytes, vocabulary: Vocabulary, splitter: Splitter) -> Encoder:
    """One encoder for each Python worker: what it remembers serves the next task with the same lexicon too."""
    mark = sha256(block).digest()
    if mark not in _encoders:
        _encoders.clear()
        _encoders[mark] = Encoder(Lexicon.mapped(block), vocabulary, splitter)
    return _encoders[mark]


def encode(documents: DataFrame, lexicon: bytes, vocabulary: Vocabulary, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds `ids` (array of int) to the columns `keep` of every row.

    The ids are those of the tokenizer whose file `vocabulary` was loaded from, without added special
    tokens; the string of a special token inside a text is that token. What the lexicon
    holds never changes the ids, only the work. A NULL or empty text has no ids. Repeated rows are
    encoded alike. A column named `ids` is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast((lexicon, vocabulary, Splitter(vocabulary.special)))

    def start():
        encoder = worker_encoder(*shared.value)

        def step(texts: list[str]) -> dict[str, object]:
            ids, bounds = encoder.encode(texts)
            return {"ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))}

        return step

    return map_texts(documents, text, documents.columns if keep is None else keep, [("ids", T.ArrayType(T.IntegerType()))], start)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of the ids. Special tokens are written out, unknown and NULL ids left out.

    Bytes that are not UTF-8 become U+FFFD. No ids, or NULL, is the empty text. A column called `name` is
    replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.token_bytes)
    source = encoded.drop(name) if name in encoded.columns and name != ids else encoded
    schema = T.StructType([f for f in source.schema.fields] + [T.StructField(name, T.StringType())])
    arrow = to_arrow_schema(schema)
    at = source.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = ByteDecoder(shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()
            for lo, hi in text_slices(sizes):
                part = batch.slice(lo, hi - lo)
                texts = decoder.decode(*flat_lists(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.string())], schema=arrow)

    return source.mapInArrow(run, schema)


class ByteDecoder:
    """Texts of ids, all rows of a batch in one gather."""

    def __init__(self, token_bytes: dict[int, bytes]):
        size = max(token_bytes, default=-1) + 1
        coded = [token_bytes.get(i, b"") for i in range(size)] + [b""]  # the last one stands for unknown ids
        lengths = np.array([len(c) for c in coded], dtype=np.int64)
        self.size, self.lengths = size, lengths
        self.begin = np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(coded), dtype=np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        known = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        lengths = self.lengths[known]
        data = self.flat[spread(self.begin[known], lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths)])[bounds].astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        try:
            texts.validate(full=True)
            return texts
        except pa.ArrowInvalid:
            raw = data.tobytes()
            rows = zip(offsets[:-1].tolist(), offsets[1:].tolist())
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in rows], pa.large_string())
