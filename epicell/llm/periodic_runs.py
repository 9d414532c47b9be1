"""Runs of a text: stretches of words that repeat with a period and cannot be extended.

Every run has a root that is a Lyndon word of one of the two orders of the alphabet. So the longest Lyndon words
that start at each word, in both orders, are the candidates. Each is extended to the right and to the left by
longest common extensions: the lowest common ancestor of two leaves of a suffix tree, of the document and of
its reversal, found in constant time on an Euler tour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.llm.common import col, text_slices

MIN_LENGTH = 6
MIN_REPEATS = 4
# a run is looked for where so many consecutive words recur at a short distance
GRAM = 3
# values of a block of the range minimum structure
BLOCK = 16
WORD_MIX = np.uint64(0x9E3779B97F4A7C15)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class SuffixTree:
    """Ukkonen's tree of a sequence of small integers, closed by an end mark that is less than all of them.

    Only what longest common extensions need is kept: an Euler tour of the depths, each leaf's place on it, and
    the ranks of the suffixes in the order of the alphabet and in the reverse one.
    """

    def __init__(self, codes: list[int], ranks: bool):
        n = len(codes) + 1
        word = [c + 1 for c in codes] + [0]
        start, end, link, arcs = self._build(word)
        self.size = n - 1
        self._tour(word, start, end, arcs, n, ranks)

    @staticmethod
    def _build(word: list[int]) -> tuple[list[int], list[int], list[int], list[dict[int, int] | None]]:
        """Nodes as arrays: where the arc into a node starts and ends (-1: the end of the text), links, children."""
        start, end, link = [0], [0], [0]
        arcs: list[dict[int, int] | None] = [{}]
        node, edge, length, open_suffixes = 0, 0, 0, 0
        for i, symbol in enumerate(word):
            open_suffixes += 1
            pending = -1
            while open_suffixes:
                if not length:
                    edge = i
                here = arcs[node]
                first = word[edge]
                child = here.get(first)
                if child is None:
                    start.append(i)
                    end.append(-1)
                    link.append(0)
                    arcs.append(None)
                    here[first] = len(start) - 1
                    if pending >= 0:
                        link[pending] = node
                    pending = node
                else:
                    begin = start[child]
                    span = (end[child] if end[child] >= 0 else i + 1) - begin
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if word[begin + length] == symbol:
                        if pending >= 0:
                            link[pending] = node
                        length += 1
                        break
                    split = len(start)
                    start += [begin, i]
                    end += [begin + length, -1]
                    link += [0, 0]
                    start[child] = begin + length
                    arcs.append({symbol: split + 1, word[begin + length]: child})
                    arcs.append(None)
                    here[first] = split
                    if pending >= 0:
                        link[pending] = split
                    pending = split
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_suffixes + 1
        return start, end, link, arcs

    def _tour(self, word: list[int], start: list[int], end: list[int], arcs: list, n: int, ranks: bool) -> None:
        depths: list[int] = []
        place = [0] * n
        order: list[int] = []
        # the last visit of a node is its return from a child; leaves are visited once
        stack: list[tuple[int, int, int]] = [(0, 0, 0)]
        while stack:
            node, depth, again = stack.pop()
            if again:
                depths.append(depth)
                continue
            children = arcs[node]
            if children is None:
                suffix = n - depth
                place[suffix] = len(depths)
                order.append(suffix)
                depths.append(depth)
                continue
            depths.append(depth)
            below = []
            for symbol in sorted(children, reverse=True):
                child = children[symbol]
                stop = end[child]
                below.append((node, depth, 1))
                below.append((child, depth + (n if stop < 0 else stop) - start[child], 0))
            stack += below
        self.place = np.array(place, dtype=np.int64)
        if ranks:
            self.rank = np.empty(n, dtype=np.int64)
            self.rank[order] = np.arange(n)
            self.reverse_rank = self._reverse_ranks(start, end, arcs, n)
        self.minima = RangeMinimum(np.array(depths, dtype=np.int32))

    @staticmethod
    def _reverse_ranks(start: list[int], end: list[int], arcs: list, n: int) -> np.ndarray:
        """Ranks with the alphabet turned round; the end mark stays the least."""
        rank = np.empty(n, dtype=np.int64)
        stack = [(0, 0)]
        at = 0
        while stack:
            node, depth = stack.pop()
            children = arcs[node]
            if children is None:
                rank[n - depth] = at
                at += 1
                continue
            symbols = sorted(children)
            if symbols[0] == 0:
                symbols = [*symbols[1:], 0]
            for symbol in symbols:  # the last one is taken first
                child = children[symbol]
                stop = end[child]
                stack.append((child, depth + (n if stop < 0 else stop) - start[child]))
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at `a` and `b`, which differ."""
        left, right = self.place[a], self.place[b]
        return self.minima.least(np.minimum(left, right), np.maximum(left, right)).astype(np.int64)


class RangeMinimum:
    """Least value of any range in constant time: a sparse table over blocks, and prefix and suffix minima within."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[: len(values)] = values
        grid = padded.reshape(blocks, BLOCK)
        self.grid = grid
        self.prefix = np.minimum.accumulate(grid, axis=1).ravel()
        self.suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        level = grid.min(axis=1)
        self.levels = [level]
        step = 1
        while 2 * step <= blocks:
            level = np.minimum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minima of the closed ranges."""
        first, last = left // BLOCK, right // BLOCK
        out = np.minimum(self.suffix[left], self.prefix[right])
        same = np.flatnonzero(first == last)
        if len(same):
            rows = self.grid[first[same]]
            at = np.arange(BLOCK)
            inside = (at >= (left[same] % BLOCK)[:, None]) & (at <= (right[same] % BLOCK)[:, None])
            out[same] = np.where(inside, rows, np.iinfo(np.int32).max).min(axis=1)
        between = last - first - 1
        for k, level in enumerate(self.levels):
            at = np.flatnonzero((between >> k) == 1)
            if len(at):
                out[at] = np.minimum(out[at], np.minimum(level[first[at] + 1], level[last[at] - (1 << k)]))
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: up to the next suffix that is smaller."""
    values = rank.tolist()
    out = [0] * (len(values) - 1)
    stack: list[int] = []
    for i, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            j = stack.pop()
            out[j] = i - j
        stack.append(i)
    return np.array(out, dtype=np.int64)


def runs_of(codes: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """All runs of a sequence of integers, as rows (start, length, period) in that order.

    A run has its smallest period q, at least max(min_length, min_repeats * q) places, and no neighbour that keeps
    the period. `min_repeats` is 2 at least.
    """
    n = len(codes)
    if n < max(2, min_length):
        return np.empty((0, 3), dtype=np.int64)
    symbols = np.unique(codes, return_inverse=True)[1].ravel()
    forward = SuffixTree(symbols.tolist(), ranks=True)
    at = np.arange(n)
    found = []
    for rank in (forward.rank, forward.reverse_rank):
        period = lyndon_lengths(rank)
        # a run holds its root once more on one side at least
        ok = at + period < n
        found.append(np.stack([at[ok], period[ok]], axis=1))
    roots = np.unique(np.concatenate(found), axis=0)
    first, period = roots[:, 0], roots[:, 1]
    right = forward.common(first, first + period)
    del forward
    backward = SuffixTree(symbols[::-1].tolist(), ranks=False)
    left = np.zeros(len(first), dtype=np.int64)
    inner = np.flatnonzero(first > 0)
    # the word before place i is the start of the suffix n - i of the reversal
    left[inner] = backward.common(n - first[inner], n - first[inner] - period[inner])
    length = left + period + right
    good = length >= np.maximum(min_length, min_repeats * period)
    return np.unique(np.stack([first - left, length, period], axis=1)[good], axis=0)


def stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def places_to_look(codes: np.ndarray, document: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int]]:
    """Disjoint ranges [first, last] of words, inside documents, that hold every run there is whole.

    In a run of period q every group of GRAM words from the second repetition on stands q places before as well. So there
    are at least max(min_length, min_repeats * q) - q - GRAM + 1 places in a row where the distance to the last same
    group is at most q. Stretches of this kind are looked for with q rounded up to powers of two.
    """
    n = len(codes)

    def in_a_row(q: int) -> int:
        return max(min_length, min_repeats * q) - q - GRAM + 1

    turn = min_length // min_repeats  # the number falls up to this period and grows after the next
    if n < GRAM or min(in_a_row(q) for q in (1, turn or 1, turn + 1)) < 1:
        return whole_documents(document)
    mixed = codes.astype(np.uint64)
    gram = mixed[: n - GRAM + 1].copy()
    for k in range(1, GRAM):
        gram = (gram * WORD_MIX) ^ (gram >> np.uint64(29)) ^ mixed[k : n - GRAM + 1 + k]
    gram = (gram * WORD_MIX) ^ (document[: n - GRAM + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    distance = np.full(len(gram), n + 1, dtype=np.int64)
    again = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
    distance[order[again]] = order[again] - order[again - 1]
    # a group that reaches into the next document ends a stretch
    distance[document[: n - GRAM + 1] != document[GRAM - 1 :]] = n + 1
    firsts, lasts = [], []
    q = 1
    while q * min_repeats <= n:
        a, b = stretches(distance < 2 * q)
        enough = b - a + 1 >= min(in_a_row(min(max(p, q), 2 * q - 1)) for p in (q, turn, turn + 1))
        firsts.append(a[enough] - (2 * q - 1))
        lasts.append(b[enough] + GRAM - 1)
        q *= 2
    if not firsts:
        return []
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    if not len(first):
        return []
    begin = np.searchsorted(document, document[last], side="left")
    first = np.maximum(first, begin)
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist())):
        if out and a <= out[-1][1] + 1 and document[a] == document[out[-1][1]]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def whole_documents(document: np.ndarray) -> list[tuple[int, int]]:
    if not len(document):
        return []
    ends = np.flatnonzero(np.diff(document)).tolist()
    return list(zip([0, *[e + 1 for e in ends]], [*ends, len(document) - 1]))


class RunFinder:
    """Runs and collapsed words of a list of texts."""

    def __init__(self, min_length: int, min_repeats: int):
        if min_repeats < 2:
            raise ValueError("a run has two repetitions at least")
        self.min_length, self.min_repeats = min_length, min_repeats

    def find(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
        """Of each text: number of words, runs (start, length, period) by start and period, kept words joined by a space."""
        words = [t.split() for t in texts]  # bytes are split at blank, tab, line feed, VT, FF and return only
        flat = [w for ws in words for w in ws]
        number = dict(zip(flat, range(len(flat))))
        codes = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = np.array([len(ws) for ws in words], dtype=np.int64)
        document = np.repeat(np.arange(len(words)), sizes)
        begin = np.cumsum(sizes) - sizes
        runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
        dropped: dict[int, np.ndarray] = {}
        for a, b in places_to_look(codes, document, self.min_length, self.min_repeats):
            found = runs_of(codes[a : b + 1], self.min_length, self.min_repeats)
            if not len(found):
                continue
            d = int(document[a])
            if d not in dropped:
                dropped[d] = np.zeros(len(words[d]) + 1, dtype=np.int64)
            found[:, 0] += a - begin[d]
            np.add.at(dropped[d], found[:, 0] + found[:, 2], 1)
            np.add.at(dropped[d], found[:, 0] + found[:, 1], -1)
            runs[d] += map(tuple, found.tolist())
        kept = []
        for d, ws in enumerate(words):
            if d in dropped:
                gone = np.cumsum(dropped[d])[:-1] > 0
                ws = [w for w, g in zip(ws, gone.tolist()) if not g]
                runs[d].sort(key=lambda r: (r[0], r[2]))
            kept.append(b" ".join(ws))
        return sizes.tolist(), runs, kept


def find_runs(
    documents: DataFrame,
    keep: list[str] | None = None,
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_repeats: int = MIN_REPEATS,
) -> DataFrame:
    """Adds `n_words`, `runs` (array of start, length, period) and `collapsed` to the columns `keep` of every row.

    Words are what lies between blanks, tabs and line ends (U+0009 to U+000D). A run is a stretch of words with smallest
    period q, at least max(min_length, min_repeats * q) long, that cannot be extended; words are numbered
    from 0, runs ordered by start, then period. `collapsed` are the words joined by one space, without
    those that a run holds after its first period.

    Where no run can be, by the distances at which groups of words recur, no tree is built; this loses none.
    The memory of a task is about 700 bytes for each word of the longest stretch that is searched.

    A NULL or empty text has no words, no runs and collapses to the empty text. Repeated rows are treated alike.
    Columns named like those added are replaced.
    """
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
    names = [f.name for f in fields]
    kept = [c for c in (documents.columns if keep is None else keep) if c not in names]
    source = documents.select(*[col(c) for c in kept], col(text).cast("string").alias("llm_text"))
    schema = T.StructType([source.schema[i] for i in range(len(kept))] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = RunFinder(min_length, min_repeats)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(len(kept))), 0).to_pylist()
            for lo, hi in text_slices(lengths):
                part = batch.slice(lo, hi - lo)
                texts = [t or b"" for t in part.column(len(kept)).cast(pa.binary()).to_pylist()]
                sizes, runs, collapsed = finder.find(texts)
                columns = list(part.columns[: len(kept)])
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
                columns += [
                    pa.array(sizes, pa.int64()),
                    pa.array(rows, type=arrow.field("runs").type),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema)
