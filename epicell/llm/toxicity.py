"""Toxic spans by a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epicell.llm.common import labelled_sample, map_texts

# about so many texts of each label, of at most MAX_CHARS characters, serve the fit
PER_LABEL = 1000
MAX_CHARS = 20_000
BUCKETS = 1 << 18
# training sequences are cut to so many words
SEQUENCE_WORDS = 64
CLEAN_SEQUENCES = 6_000
ROUNDS = 3
# a small sample is gone over more often, up to so many steps
LEAST_STEPS = 120
BATCH = 256
STEP = 0.3
DECAY = 1e-5
# a word form counts as toxic evidence from this smoothed log ratio of document rates on
EVIDENCE = 3.0
EVIDENCE_DOCS = 2
SPAN_MARGINAL = 0.5
CHUNK_WORDS = 256
RESCALE = 8
REMEMBERED_WORDS = 300_000
# state scores and the log odds of a text's surest word stay within these
FARTHEST = 40.0
SUREST = 12.0

WORD = re.compile(r"\w+")


def forms(word: str) -> list[str]:
    """What the field sees of a word: itself, its beginnings and its ends."""
    w = word.lower()
    out = ["=" + w]
    out += ["^" + w[:k] for k in (3, 4, 5) if len(w) > k]
    out += ["$" + w[-k:] for k in (3, 4) if len(w) > k]
    return out


def buckets(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % BUCKETS for f in forms(word)]


@dataclass
class Field:
    """State weights by bucket for the toxic label (the clean one has 0), and log transitions."""

    weights: np.ndarray  # float32 [BUCKETS]
    bias: float
    start: np.ndarray  # [2]
    moves: np.ndarray  # [2, 2]
    document: np.ndarray  # weights of `document_inputs`, constant first; empty: nothing was learnt


def marginals(scores: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of every word by forward-backward, for many texts laid end to end.

    `scores` are the state scores of the toxic label, `first` marks the first word of a text.
    A step is a 2 x 2 matrix; at the start of a text its rows are equal, so nothing crosses from one
    text to the next. The products of CHUNK_WORDS steps are taken for all chunks at once, the chunks
    are then chained, and each is walked again from its true message: exact, with few numpy calls.
    """
    n = len(scores)
    if not n:
        return np.zeros(0)
    chunks = -(-n // CHUNK_WORDS)
    size = chunks * CHUNK_WORDS
    # the state score is split evenly over both labels, which keeps exp() in range
    half = np.clip(scores, -FARTHEST, FARTHEST) / 2
    low, high = np.exp(-half), np.exp(half)
    move, begin = np.exp(moves - moves.max()), np.exp(start - start.max())

    def entry(i: int, j: int, column: np.ndarray) -> np.ndarray:
        out = np.full(size, float(i == j))
        out[:n] = np.where(first, begin[j], move[i, j]) * column
        return np.ascontiguousarray(out.reshape(chunks, CHUNK_WORDS).T)

    s00, s01, s10, s11 = entry(0, 0, low), entry(0, 1, high), entry(1, 0, low), entry(1, 1, high)
    w00, w01, w10, w11 = s00[0], s01[0], s10[0], s11[0]
    for t in range(1, CHUNK_WORDS):
        w00, w01 = w00 * s00[t] + w01 * s10[t], w00 * s01[t] + w01 * s11[t]
        w10, w11 = w10 * s00[t] + w11 * s10[t], w10 * s01[t] + w11 * s11[t]
        if t % RESCALE == 0:
            top = 1 / np.maximum(np.maximum(w00, w01), np.maximum(w10, w11))
            w00, w01, w10, w11 = w00 * top, w01 * top, w10 * top, w11 * top
    whole = list(zip(w00.tolist(), w01.tolist(), w10.tolist(), w11.tolist()))

    def chain(steps: list, forth: bool) -> tuple[np.ndarray, np.ndarray]:
        x, y, out = 1.0, 1.0, []
        for a, b, c, d in steps:
            out.append((x, y))
            x, y = (x * a + y * c, x * b + y * d) if forth else (a * x + b * y, c * x + d * y)
            top = max(x, y)
            x, y = x / top, y / top
        pairs = np.array(out)
        return pairs[:, 0], pairs[:, 1]

    x, y = chain(whole, True)
    f0, f1 = np.empty((CHUNK_WORDS, chunks)), np.empty((CHUNK_WORDS, chunks))
    for t in range(CHUNK_WORDS):
        x, y = x * s00[t] + y * s10[t], x * s01[t] + y * s11[t]
        top = 1 / np.maximum(x, y)
        x, y = x * top, y * top
        f0[t], f1[t] = x, y
    x, y = (v[::-1] for v in chain(whole[::-1], False))
    for t in range(CHUNK_WORDS - 1, -1, -1):
        f0[t] *= x
        f1[t] *= y
        x, y = s00[t] * x + s01[t] * y, s10[t] * x + s11[t] * y
        top = 1 / np.maximum(x, y)
        x, y = x * top, y * top
    return (f1 / (f0 + f1)).T.reshape(-1)[:n]


def document_inputs(p: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """Per text: the log odds of its surest word and the expected number of toxic words, logged.

    `first_word` has the places where the texts begin and the number of words at the end; a text
    without words has the least values.
    """
    counts = np.diff(first_word)
    out = np.zeros((len(counts), 2))
    out[:, 0] = -SUREST
    full = counts > 0
    if full.any():
        at = first_word[:-1][full]
        top = np.maximum.reduceat(p, at)
        top = np.clip(top, 1e-12, 1 - 1e-12)
        out[full, 0] = np.clip(np.log(top / (1 - top)), -SUREST, SUREST)
        out[full, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.1, p, 0.0), at))
    return out


def token_labels(rows: list[Row]) -> dict[str, float]:
    """Word forms that speak for toxicity, from labelled texts: form -> log ratio of document rates."""
    toxic, clean = Counter(), Counter()
    n_toxic = n_clean = 0
    for row in rows:
        seen = {f for w in set(WORD.findall(row["text"])) for f in forms(w)}
        if row["label"]:
            toxic.update(seen)
            n_toxic += 1
        else:
            clean.update(seen)
            n_clean += 1
    out = {}
    for form, n in toxic.items():
        if n >= EVIDENCE_DOCS:
            ratio = np.log((n + 0.1) / (n_toxic + 1)) - np.log((clean[form] + 0.1) / (n_clean + 1))
            if ratio >= EVIDENCE:
                out[form] = float(ratio)
    return out


def fit(rows: list[Row], counts: dict[object, int], seed: int = 7) -> Field:
    """The field from labelled texts.

    Labels of texts become labels of words: in a text labelled toxic, a word is toxic when one of
    its forms speaks for it (`token_labels`); in a clean text none is. The weights follow the gradient
    of the conditional likelihood, whose expectations are the forward-backward marginals. A
    logistic model then maps what `document_inputs` says of a text to its label.
    """
    none = Field(np.zeros(BUCKETS, dtype=np.float32), 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros(0))
    if {bool(r["label"]) for r in rows} != {True, False}:
        return none
    evidence = token_labels(rows)
    rng = np.random.default_rng(seed)
    marked, plain = [], []
    for row in rows:
        words = WORD.findall(row["text"])
        y = np.array([bool(row["label"]) and any(f in evidence for f in forms(w)) for w in words], dtype=float)
        for at in range(0, len(words), SEQUENCE_WORDS):
            part = y[at : at + SEQUENCE_WORDS]
            if part.any() or not row["label"]:
                (marked if part.any() else plain).append((words[at : at + SEQUENCE_WORDS], part))
    order = rng.permutation(len(plain))[:CLEAN_SEQUENCES]
    sequences = marked + [plain[i] for i in order]
    memo: dict[str, list[int]] = {}
    w, bias = np.zeros(BUCKETS), 0.0
    square, bias_square = np.full(BUCKETS, 1e-3), 1e-3
    start, moves = np.zeros(2), np.zeros((2, 2))
    start_square, moves_square = np.full(2, 1e-3), np.full((2, 2), 1e-3)
    for _ in range(max(ROUNDS, -(-LEAST_STEPS * BATCH // len(sequences)))):
        order = rng.permutation(len(sequences))
        for lo in range(0, len(order), BATCH):
            part = [sequences[i] for i in order[lo : lo + BATCH]]
            ids, owner, first, y, t = [], [], [], [], 0
            for words, labels in part:
                for i, word in enumerate(words):
                    b = memo.get(word)
                    if b is None:
                        b = memo[word] = buckets(word)
                    ids += b
                    owner += [t] * len(b)
                    first.append(i == 0)
                    t += 1
                y.append(labels)
            ids, owner, first, y = np.array(ids), np.array(owner), np.array(first), np.concatenate(y)
            p, pair = _expected(np.bincount(owner, w[ids], t) + bias, first, start, moves)
            off = (y - p) / len(part)
            g = np.bincount(ids, off[owner], BUCKETS) - DECAY * w
            touched = np.unique(ids)
            square[touched] += g[touched] ** 2
            w[touched] += STEP * g[touched] / np.sqrt(square[touched])
            bias_square += off.sum() ** 2
            bias += STEP * off.sum() / np.sqrt(bias_square)
            inner = ~first
            now, before = y[inner], y[np.flatnonzero(inner) - 1]
            seen = np.array([[((1 - before) * (1 - now)).sum(), ((1 - before) * now).sum()], [(before * (1 - now)).sum(), (before * now).sum()]])
            g_moves = (seen - pair) / len(part)
            moves_square += g_moves**2
            moves += STEP * g_moves / np.sqrt(moves_square)
            g_start = np.array([(p - y)[first].sum(), (y - p)[first].sum()]) / len(part)
            start_square += g_start**2
            start += STEP * g_start / np.sqrt(start_square)
    found = Field(w.astype(np.float32), float(bias), start, moves, np.zeros(0))
    return Field(found.weights, found.bias, start, moves, _fit_document(found, rows, counts))


def _expected(scores: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the words and expected counts of the moves within short sequences."""
    n, at = len(scores), np.flatnonzero(first)
    length = np.diff(np.append(at, n))
    half = np.clip(scores, -FARTHEST, FARTHEST) / 2
    e = np.exp(np.stack([-half, half], axis=1))
    m, begin = np.exp(moves - moves.max()), np.exp(start - start.max())
    f, b = np.empty((n, 2)), np.empty((n, 2))
    for t in range(length.max()):
        rows = at[length > t] + t
        x = (begin if t == 0 else f[rows - 1] @ m) * e[rows]
        f[rows] = x / x.sum(axis=1, keepdims=True)
    for t in range(1, length.max() + 1):
        rows = (at + length)[length >= t] - t
        x = np.ones((len(rows), 2)) if t == 1 else (b[rows + 1] * e[rows + 1]) @ m.T
        b[rows] = x / x.sum(axis=1, keepdims=True)
    p = (f * b)[:, 1] / (f * b).sum(axis=1)
    i = np.flatnonzero(~np.append(first[1:], True))  # words with a successor
    pair = f[i][:, :, None] * m[None] * (e[i + 1] * b[i + 1])[:, None, :]
    return p, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _fit_document(model: Field, rows: list[Row], counts: dict[object, int]) -> np.ndarray:
    tagger = Tagger(model)
    x = np.concatenate([tagger.read([r["text"] for r in rows[i : i + 200]])[2] for i in range(0, len(rows), 200)])
    y = np.array([bool(r["label"]) for r in rows], dtype=float)
    # the sample has both labels alike; the weights bring back their true shares
    share = {v: sum(n for k, n in counts.items() if bool(k) == v) / max(1, (y == v).sum()) for v in (True, False)}
    weight = np.where(y > 0, share[True], share[False])
    weight /= weight.sum()
    x = np.column_stack([np.ones(len(x)), x])
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(theta))
        theta += np.linalg.solve(curve, x.T @ (weight * (y - p)) - 1e-4 * theta)
    return theta


class Tagger:
    """Applies a field to texts; remembers the scores of words."""

    def __init__(self, model: Field):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores: list[float] = []

    def _score(self, word: str) -> int:
        at = self.known[word] = len(self.scores)
        self.scores.append(float(self.model.weights[buckets(word)].sum()) + self.model.bias)
        return at

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all words, the places where the texts begin, the inputs of their scores."""
        if len(self.known) > REMEMBERED_WORDS:
            self._forget()
        places, begins = [], [0]
        for text in texts:
            words = WORD.findall(text)
            found = list(map(self.known.get, words))
            if None in found:
                for i, at in enumerate(found):
                    if at is None:
                        word = words[i]
                        found[i] = self.known[word] if word in self.known else self._score(word)
            places += found
            begins.append(len(places))
        begins = np.array(begins)
        scores = np.array(self.scores)[np.array(places, dtype=np.int64)] if places else np.zeros(0)
        first = np.zeros(len(places), dtype=bool)
        first[begins[:-1][np.diff(begins) > 0]] = True
        p = marginals(scores, first, self.model.start, self.model.moves)
        return p, begins, document_inputs(p, begins)

    def score(self, texts: list[str]) -> dict[str, object]:
        p, begins, x = self.read(texts)
        if len(self.model.document):
            z = self.model.document[0] + x @ self.model.document[1:]
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        else:
            scores = np.zeros(len(texts))
        spans = []
        for text, lo, hi in zip(texts, begins[:-1], begins[1:]):
            spans.append(self._spans(text, p[lo:hi]) if hi > lo and p[lo:hi].max() >= SPAN_MARGINAL else [])
        return {"toxicity": scores, "toxic_spans": spans}

    @staticmethod
    def _spans(text: str, p: np.ndarray) -> list[dict[str, object]]:
        out: list[dict[str, object]] = []
        open_span = False
        for word, value in zip(WORD.finditer(text), p):
            if value < SPAN_MARGINAL:
                open_span = False
            elif open_span:
                out[-1] |= {"end": word.end(), "marginal": max(out[-1]["marginal"], float(value))}
            else:
                out.append({"start": word.start(), "end": word.end(), "marginal": float(value)})
                open_span = True
        return out


SPAN = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())]
)


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Field:
    """Fit on a bounded sample (PER_LABEL texts of a label, MAX_CHARS characters) of the labelled texts given."""
    return fit(*labelled_sample(documents, labels, label, PER_LABEL, MAX_CHARS, key, text))


def tag_toxicity(documents: DataFrame, model: Field, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds `toxicity` (0 to 1) and `toxic_spans` (start, end, largest marginal) to the columns `keep`.

    Whole texts are read. Offsets count characters; a span is a run of words whose marginals reach
    SPAN_MARGINAL. A NULL, empty or wordless text has the score of a text without any sign of
    toxicity and no span. If the model was fitted without labels of both kinds, every score is 0.
    Repeated rows are scored alike. Columns named like a result are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = [("toxicity", T.DoubleType()), ("toxic_spans", T.ArrayType(SPAN))]
    return map_texts(documents, text, documents.columns if keep is None else keep, fields, lambda: Tagger(shared.value).score)


def drop_toxic(documents: DataFrame, model: Field, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows whose score is under the threshold, with their own columns."""
    tagged = tag_toxicity(documents, model, [c for c in documents.columns if c not in ("toxicity", "toxic_spans")], text)
    kept = tagged.where(F.col("toxicity") < threshold)
    return kept.select(*documents.columns) if not {"toxicity", "toxic_spans"} & set(documents.columns) else kept
