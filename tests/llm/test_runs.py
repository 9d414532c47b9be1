"""Runs against a plain search over all periods, and the query against the words themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from epicell.llm import periodic_runs, queries

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_words(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_runs(words, min_length=6, min_repeats=4):
    n, out = len(words), []
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(words[j] == words[j + d] for j in range(start, start + length - d)) for d in range(1, q))
            if length >= max(min_length, min_repeats * q) and not smaller:
                out.append((start, length, q))
    return sorted(out)


def random_words(rng):
    k, n = rng.randint(1, 5), rng.randint(0, 70)
    words = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.6 and n > 4:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("min_length, min_repeats", [(6, 4), (2, 2), (3, 2), (9, 3), (20, 2)])
def test_runs_equal_a_search_over_periods(min_length, min_repeats):
    rng = random.Random(min_length * 10 + min_repeats)
    finder = periodic_runs.RunFinder(min_length, min_repeats)
    for _ in range(600):
        words = random_words(rng)
        want = plain_runs(words, min_length, min_repeats)
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(words, dtype=np.int64), min_length, min_repeats).tolist()] == want
        # between other texts, through the search for places
        others = [random_words(rng) for _ in range(3)]
        _, runs, _ = finder.find([" ".join(map(str, ws)).encode() for ws in (others[0], words, [], words, *others[1:])])
        assert runs[1] == runs[3] == want and runs[2] == []
        assert runs[0] == plain_runs(others[0], min_length, min_repeats)


def test_long_runs_inside_prose():
    rng = random.Random(8)
    words = [str(rng.randrange(3000)) for _ in range(40_000)]
    for at, period, times in ((100, 1, 9), (900, 250, 5), (9000, 3001, 4), (35_000, 17, 30)):
        words[at : at + period * times] = words[at : at + period] * times
    _, runs, kept = periodic_runs.RunFinder(6, 4).find([" ".join(words).encode()])
    assert [(s, q) for s, _, q in runs[0]] == [(100, 1), (900, 250), (9000, 3001), (35_000, 17)]
    assert len(kept[0].split()) == 40_000 - sum(n - q for _, n, q in runs[0])


def test_common_extensions_and_lyndon_words():
    rng = random.Random(5)
    for _ in range(200):
        codes = [rng.randrange(3) for _ in range(rng.randint(2, 40))]
        tree = periodic_runs.SuffixTree(codes, ranks=True)
        n = len(codes)
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
        a, b = np.array(pairs).T

        def plain(i, j):
            k = 0
            while max(i, j) + k < n and codes[i + k] == codes[j + k]:
                k += 1
            return k

        assert tree.common(a, b).tolist() == [plain(i, j) for i, j in pairs]
        for sign, rank in ((1, tree.rank), (-1, tree.reverse_rank)):
            suffixes = [[sign * c for c in codes[i:]] for i in range(n + 1)]
            assert np.argsort(rank).tolist() == sorted(range(n + 1), key=lambda i: suffixes[i])


def check_query(rows, texts):
    planted = 0
    assert len(rows) == len(texts)
    for row in rows:
        key, text = texts[row.doc_id]
        words = plain_words(text or "")
        h = zlib.crc32(str(key).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = [tuple(r) for r in periodic_runs.runs_of(np.unique(words, return_inverse=True)[1])] if n > 2000 else plain_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        assert row.n_runs == len(runs)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (row.start, row.length, row.period, row.exponent_milli) == want
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    return planted


def test_query_equals_plain_words(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 9000 OR text IS NULL")
    texts = {r.doc_id: (r.doc_id, r.text) for r in documents.collect()}
    rows = [r for r in queries.op13_periodic_runs(spark, folder).collect() if r.doc_id in texts]
    assert check_query(rows, texts) > 5


def test_awkward_rows(spark, odd, nothing):
    rows = periodic_runs.find_runs(odd.withColumn("runs", odd.doc_id), keep=["doc_id", "runs", "text"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = plain_words(r.text or "")
        assert r.n_words == len(words)
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == plain_runs(words)
        else:
            assert [tuple(x) for x in r.runs] == [(0, len(words), 8)] and r.collapsed == " ".join(words[:8])
    assert periodic_runs.find_runs(nothing).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.RunFinder(4, 1)
