"""Language of texts by a convolutional network over their bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epicell.llm.common import col, map_texts, text_slices

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
# about so many texts of each language serve the fit, WINDOWS_EACH windows of a text
PER_LANGUAGE = 800
WINDOWS_EACH = 3
SAMPLE_TEXTS = 160_000
LEAST_TEXTS = 20
LANGUAGES = 10_000
ROUNDS = 8
# a small sample is gone over more often, up to so many steps
LEAST_STEPS = 500
BATCH = 128
STEP = 0.003
# windows that a task holds at a time
BLOCK = 512


@dataclass
class Network:
    """Embedding [256, E]; per width a kernel [width, E, FILTERS] and bias; dense [filters, languages]."""

    languages: list[str]
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    shift: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray | None]] = field(default_factory=list)

    def prepare(self) -> "Network":
        """For each width the responses to pairs of bytes: a filter is a sum of two table rows."""
        self.tables = []
        e = self.embedding
        for kernel, bias in zip(self.kernels, self.biases):
            taps = [e @ kernel[j] for j in range(len(kernel))]
            head = (taps[0][:, None] + taps[1][None] + bias).reshape(65536, -1).astype(np.float32)
            if len(taps) == 2:
                rest = None
            elif len(taps) == 3:
                rest = taps[2].astype(np.float32)
            else:
                rest = (taps[2][:, None] + taps[3][None]).reshape(65536, -1).astype(np.float32)
            self.tables.append((head, rest))
        return self

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Largest response of every filter in every window [n, WINDOW] of bytes."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        out = []
        for width, (head, rest) in zip(WIDTHS, self.tables):
            n = WINDOW - width + 1
            x = head.take(pairs[:, :n], axis=0)
            if width == 3:
                x += rest.take(windows[:, 2:], axis=0)
            elif width == 4:
                x += rest.take(pairs[:, 2:], axis=0)
            out.append(np.maximum(x.max(axis=1), 0))
        return np.concatenate(out, axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.dense + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text of each, and its share of real bytes; the last is padded with 0.

    Windows of a text follow each other without a gap, so every byte counts.
    """
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], dtype=np.int64)
    flat = np.zeros(int(counts.sum()) * WINDOW, dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(counts)]) * WINDOW
    real = np.ones(int(counts.sum()))
    for i, t in enumerate(texts):
        flat[at[i] : at[i] + len(t)] = np.frombuffer(t, dtype=np.uint8)
        real[at[i + 1] // WINDOW - 1] = (len(t) - (counts[i] - 1) * WINDOW) / WINDOW
    return flat.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts), np.maximum(real, 1 / WINDOW)


def fit(samples: list[tuple[bytes, str]], seed: int = 5) -> Network | None:
    """A network from (window of at most WINDOW bytes, language); None without any.

    Max pooling passes the gradient to the winning position of a filter alone, so a step touches
    few positions. The steps are Adam's.
    """
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    x, _, _ = cut_windows([w for w, _ in samples])
    y = np.array([languages.index(lang) for _, lang in samples])
    weight = (len(y) / np.bincount(y))[y] / len(languages)
    total = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)),
        [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 1 / np.sqrt(total), (total, len(languages))),
        np.zeros(len(languages)),
    )
    weights = [net.embedding, *net.kernels, *net.biases, net.dense, net.shift]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(max(ROUNDS, -(-LEAST_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            windows = x[rows].astype(np.int64)
            n = len(rows)
            pooled, best = [], []
            for width, kernel, bias in zip(WIDTHS, net.kernels, net.biases):
                m = WINDOW - width + 1
                response = sum((net.embedding @ kernel[j])[windows[:, j : j + m]] for j in range(width)) + bias
                best.append(response.argmax(axis=1))
                pooled.append(np.take_along_axis(response, best[-1][:, None, :], axis=1)[:, 0])
            z = np.concatenate(pooled, axis=1)
            hidden = np.maximum(z, 0)
            logits = hidden @ net.dense + net.shift
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[rows]] -= 1
            off = p * weight[rows][:, None] / n
            back = (off @ net.dense.T) * (z > 0)
            g_embedding, g_kernels, g_biases = np.zeros_like(net.embedding), [], []
            for k, (width, kernel) in enumerate(zip(WIDTHS, net.kernels)):
                d = back[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(kernel)
                for j in range(width):
                    seen = np.take_along_axis(windows, best[k] + j, axis=1)
                    g[j] = np.einsum("nfe,nf->ef", net.embedding[seen], d)
                    np.add.at(g_embedding, seen, d[:, :, None] * kernel[j].T[None])
                g_kernels.append(g)
                g_biases.append(d.sum(axis=0))
            step += 1
            for w, g, a, b in zip(weights, [g_embedding, *g_kernels, *g_biases, hidden.T @ off, off.sum(axis=0)], first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= STEP * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.dense, net.shift = net.dense.astype(np.float32), net.shift.astype(np.float32)
    return net


def language_sample(documents: DataFrame, key: str, text: str, language: str) -> list[tuple[bytes, str]]:
    """Windows of a bounded sample: about PER_LANGUAGE texts of each language, fewer where there are more languages
    than SAMPLE_TEXTS has room for. LANGUAGES, which is more than there are in the world, bounds what is collected.

    Twice as many texts at most, evenly by a hash of the key; of each text WINDOWS_EACH windows,
    spread evenly over it. The windows are cut where the texts are, so only they move.
    """
    known = documents.where(col(language).isNotNull() & (F.length(col(text)) > 0))
    counts = known.groupBy(col(language).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    out = []
    if not counts:
        return out
    each = max(LEAST_TEXTS, min(PER_LANGUAGE, SAMPLE_TEXTS // len(counts)))
    shares = [(r["lang"], int(1_000_000 * min(1.0, each / r["n"])) + 1) for r in counts]
    share = documents.sparkSession.createDataFrame(shares, "llm_lang string, llm_share long")
    size = F.length(col(text))

    def part(i: int) -> Column:
        start = F.floor((size - WINDOW) * i / max(1, WINDOWS_EACH - 1))
        return F.substr(col(text), F.greatest(F.lit(0), start).cast("int") + 1, F.lit(WINDOW))

    place = F.pmod(F.xxhash64(col(key)), F.lit(1_000_000))
    # at most LANGUAGES rows
    chosen = known.join(F.broadcast(share), (col(language).cast("string") == F.col("llm_lang")) & (place < F.col("llm_share")))
    rows = chosen.select(F.col("llm_lang").alias("lang"), F.array_distinct(F.array(*[part(i) for i in range(WINDOWS_EACH)])).alias("parts"))
    for row in rows.limit(2 * each * len(counts)).collect():
        out += [(p.encode()[:WINDOW], row["lang"]) for p in row["parts"]]
    return sorted(out)


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> Network | None:
    """Fit on a bounded sample of the texts that have a language. NULL and empty texts and NULL languages are left out;
    without any language there is no model. Repeated rows count each."""
    return fit(language_sample(documents, key, text, language))


def identify(documents: DataFrame, model: Network | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds `lang_pred` and `lang_score` to the columns `keep` of every row.

    A whole text is cut into windows of WINDOW bytes, the last padded; the score of a language is its mean
    probability over the windows, weighted by their real bytes, and the best one is predicted.
    A NULL text, an empty one and one without a letter is `und` with score 0. Without a
    model (a fit without any language) every row is `und`. Repeated rows are answered
    alike. Columns named like a result are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = [("lang_pred", T.StringType()), ("lang_score", T.DoubleType())]

    def start():
        net = shared.value.prepare() if shared.value is not None else None

        def step(texts: list[str]) -> dict[str, object]:
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            data = [t.encode() for t in texts]
            readable = [i for i, t in enumerate(texts) if net is not None and any(map(str.isalpha, t))]
            for lo, hi in text_slices([len(data[i]) for i in readable], BLOCK * WINDOW * 4):
                rows = readable[lo:hi]
                windows, owner, real = cut_windows([data[i] for i in rows])
                p = np.concatenate([net.probabilities(windows[at : at + BLOCK]) for at in range(0, len(windows), BLOCK)])
                sums = np.zeros((len(rows), len(net.languages)))
                np.add.at(sums, owner, p * real[:, None])
                sums /= sums.sum(axis=1, keepdims=True)
                for i, k in zip(range(len(rows)), sums.argmax(axis=1)):
                    pred[rows[i]], score[rows[i]] = net.languages[k], sums[i, k]
            return {"lang_pred": pred, "lang_score": score}

        return step

    return map_texts(documents, text, documents.columns if keep is None else keep, fields, start)


def keep_readable(documents: DataFrame, model: Network | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows in a language that the model knows, with a score of at least `least`; adds both columns."""
    return identify(documents, model, text=text).where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least))
