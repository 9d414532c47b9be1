"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from epicell.llm import importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, longest=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(documents, targets):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""
    found = [(key, *plain_features(text)) for key, text in documents]
    source, target = Counter(b for _, _, fs in found for b in fs), Counter(b for t in targets for b in plain_features(t)[1])
    s_all, t_all = sum(source.values()) + 10_000, sum(target.values()) + 10_000
    gain = [math.floor(1000 * math.log((target[b] + 1) * s_all / ((source[b] + 1) * t_all))) for b in range(10_000)]
    rows = []
    for key, n, fs in found:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in fs)
        rows.append((key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = 5 * len(able) // 100
    return rows, [(r[0], r[3], i + 1) for i, r in enumerate(able[:drawn])]


def check(result, documents, targets):
    got = result.select("doc_id", "n_features", "weight", "score", "rank").collect()
    rows, drawn = plain(documents, targets)
    assert Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in rows)
    assert sorted(((r.doc_id, r.score, r.rank) for r in got if r.rank is not None), key=lambda r: r[2]) == drawn
    return drawn


def test_query_equals_a_plain_computation(spark, folder):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    targets = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert check(queries.op11_importance(spark, folder), documents, targets)


def test_spans_are_those_of_words():
    rng = random.Random(11)
    hasher = importance.NgramHasher(3, 10_000)
    letters = ["a", "B", "z", "0", "é", "É", "中", " ", "  ", "-", "\n", "\x00", "\x7f", "@", "`", "{", "\x80", "İ"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        n, buckets = hasher.hash(text)
        assert (n, buckets.tolist()) == plain_features(text)
    n, buckets = importance.NgramHasher(1, 70_000).hash("one two")
    assert n == 2 and buckets.tolist() == [zlib.crc32(w) % 70_000 for w in (b"one", b"two")]
    assert len(importance.NgramHasher(5, 100).hash("a b c d e f")[1]) == 6 + 5 + 4 + 3 + 2


def test_ranks_over_many_ranges_with_ties(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(400), rng.choice([-5, 0, 0, 7, 7, 7, 900, -(10**9)]), rng.random() < 0.8) for _ in range(3000)]
    rows += [(None, 7, True), (5, 900, True), (5, 900, True)]
    scored = spark.createDataFrame(rows, "doc_id long, score long, able boolean").repartition(7).cache()
    for percent in (0, 1, 30, 100):
        got = [r for r in importance.rank_largest(scored, scored.able, percent).collect() if r.rank]
        able = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        want = able[: percent * len(able) // 100]
        assert [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [r[:2] for r in want]
        assert sorted(r.rank for r in got) == list(range(1, len(want) + 1))


def test_awkward_rows(odd, nothing):
    short = odd.where("text IS NULL OR length(text) < 1000")
    many = odd
    for _ in range(39):
        many = many.unionByName(short)
    check(importance.resample(many, odd), [(r.doc_id, r.text) for r in many.collect()], [r.text for r in odd.collect()])
    check(importance.resample(odd, nothing), [(r.doc_id, r.text) for r in odd.collect()], [])
    assert importance.resample(nothing, odd).count() == 0


def test_gains_of_nothing():
    assert importance.bucket_gains(np.zeros(4, dtype=np.int64), np.zeros(4, dtype=np.int64)).tolist() == [0] * 4
