"""Toxicity, quality and language: exact inference, awkward rows, and what they learn."""

import numpy as np
import pytest

from epicell.llm import byte_cnn, quality, toxicity
from epicell.llm.common import labelled_sample


def brute_marginals(scores, start, moves):
    """All label sequences, one by one."""
    n = len(scores)
    weight = np.zeros(2**n)
    for code in range(2**n):
        y = [code >> t & 1 for t in range(n)]
        z = start[y[0]] + sum(s * v for s, v in zip(scores, y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))
        weight[code] = np.exp(z)
    return np.array([weight[[c >> t & 1 == 1 for c in range(2**n)]].sum() for t in range(n)]) / weight.sum()


def test_marginals_equal_brute_force_over_texts_laid_end_to_end():
    rng = np.random.default_rng(1)
    start, moves = rng.normal(size=2), rng.normal(size=(2, 2)) * 2
    texts = [rng.normal(size=n) * 3 for n in (1, 5, 9, 2, 11)] * 40
    first = np.concatenate([np.arange(len(t)) == 0 for t in texts])
    got = toxicity.marginals(np.concatenate(texts), first, start, moves)
    want = np.concatenate([brute_marginals(t, start, moves) for t in texts[:5]] * 40)
    assert len(got) > 2 * toxicity.CHUNK_WORDS
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
    inner, _ = toxicity._expected(np.concatenate(texts), first, start, moves)
    np.testing.assert_allclose(inner, want, rtol=1e-9, atol=1e-12)


def test_factorisation_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    inputs = quality.Reader().read(["a b b c", "", "x " * 30 + "\n!!"])
    size = quality.WORD_BUCKETS + quality.STATISTICS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)), np.zeros(quality.STATISTICS), np.full(quality.STATISTICS, 9.0))
    dense = np.zeros((3, size))
    dense[inputs.owner, inputs.bucket] = inputs.value
    dense[:, quality.WORD_BUCKETS :] = inputs.statistics(m)
    for row, got in zip(dense, m.score(inputs)):
        at = np.flatnonzero(row)
        pairs = sum(m.factors[i] @ m.factors[j] * row[i] * row[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert got == pytest.approx(0.3 + m.linear @ row + pairs)


def test_network_responses_equal_a_plain_convolution():
    net = byte_cnn.fit([(b"abc abd", "x"), (b"zyx zzy", "y")]).prepare()
    windows, owner, real = byte_cnn.cut_windows([b"hello world", b"", b"q" * (byte_cnn.WINDOW + 3)])
    assert owner.tolist() == [0, 1, 2, 2] and real[0] == 11 / byte_cnn.WINDOW and real[3] == 3 / byte_cnn.WINDOW
    want = []
    for width, kernel, bias in zip(byte_cnn.WIDTHS, net.kernels, net.biases):
        e = net.embedding[windows]
        n = byte_cnn.WINDOW - width + 1
        z = sum(e[:, j : j + n] @ kernel[j] for j in range(width)) + bias
        want.append(np.maximum(z.max(axis=1), 0))
    np.testing.assert_allclose(net.pooled(windows), np.concatenate(want, axis=1), rtol=1e-4, atol=1e-5)


@pytest.fixture(scope="module")
def models(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.train(documents, labels), quality.train(documents, labels), byte_cnn.train(documents)


def test_awkward_rows(models, odd, nothing):
    toxic, good, net = models
    n = odd.count()
    tagged = toxicity.tag_toxicity(odd, toxic)
    assert tagged.columns.count("toxicity") == 1 and set(tagged.columns) == set(odd.columns)
    rows = tagged.collect()
    assert len(rows) == n and all(0 <= r.toxicity <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].toxicity == by[3].toxicity == by[8].toxicity and by[2].toxic_spans == []
    assert len({r.toxicity for r in rows if r.doc_id in (6, None)}) == 1
    scored = quality.score_quality(odd, good).collect()
    assert len(scored) == n and all(0 <= r.quality_score <= 1 for r in scored)
    found = byte_cnn.identify(odd, net).collect()
    assert len(found) == n
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {2, 3, 4, 8}
    assert all(r.lang_score == 0 for r in found if r.lang_pred == "und")
    for empty in (toxicity.tag_toxicity(nothing, toxic), quality.score_quality(nothing, good), byte_cnn.identify(nothing, net)):
        assert empty.count() == 0
    assert set(toxicity.drop_toxic(odd, toxic).columns) == set(odd.columns)


def test_fits_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    field = toxicity.train(odd, labels)
    assert {r.toxicity for r in toxicity.tag_toxicity(odd, field, ["doc_id"]).collect()} == {0.0}
    assert {r.quality_score for r in quality.score_quality(odd, quality.train(odd, labels), ["doc_id"]).collect()} == {1.0}
    none = byte_cnn.train(odd.where("doc_id = 2"))
    assert {r.lang_pred for r in byte_cnn.identify(odd, none, ["doc_id"]).collect()} == {"und"}


def test_spans_point_at_insults(models, spark):
    text = "Of the and therhe with worthless idiot reen thatble."
    row = toxicity.tag_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), models[0]).first()
    assert all(text[s.start : s.end].strip() for s in row.toxic_spans)


@pytest.mark.parametrize("kind", ["toxic", "quality", "lang"])
def test_held_out_accuracy(spark, kind):
    from epicell.llm import queries

    folder = "/root/testdata/sf0.1"
    if kind == "lang":
        rows = queries.op5_language(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
        assert rows.selectExpr("avg(cast(lang = lang_pred as int)) as a").first().a > 0.98
        return
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    run = queries.op1_toxicity if kind == "toxic" else queries.op2_quality
    rows = run(spark, folder).where("held_out").join(labels, "doc_id").selectExpr(f"avg(cast(predicted = {kind} as int)) as a").first()
    assert rows.a > 0.97


def test_sample_has_one_text_of_a_key(spark):
    rows = [(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    found, counts = labelled_sample(documents, labels, "toxic", 5, 100)
    assert [tuple(r) for r in found] == [(1, "text 0", 1), (2, "b", 0)] and counts == {1: 1, 0: 2}


def test_more_than_two_hundred_languages_are_sampled(spark):
    rows = spark.range(2010).selectExpr("id AS doc_id", "concat('text of language ', id % 201) AS text", "concat('l', id % 201) AS lang")
    found = byte_cnn.language_sample(rows, "doc_id", "text", "lang")
    assert len({lang for _, lang in found}) == 201


def test_metadata_is_a_feature_of_its_own(spark):
    # the label is in the metadata alone
    rows = [(i, "the same words everywhere", float(10 ** (i % 2 * 3)), "ab"[i % 2], None, i % 2) for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, size double, kind string, empty string, quality int")
    for columns in (["size"], ["kind", "empty"]):
        model = quality.train(documents, documents, metadata=columns)
        scored = quality.score_quality(documents, model, keep=["doc_id"]).collect()
        assert all((r.quality_score > 0.5) == (r.doc_id % 2 == 1) for r in scored)
    plain = quality.train(documents, documents)
    assert plain.metadata == () and len({r.quality_score for r in quality.score_quality(documents, plain).collect()}) == 1
    marks = [quality.metadata_mark("n", v) for v in (None, float("nan"), 0, -5, 5, "x", True)]
    assert len(set(marks)) == 6 and marks[0] == marks[1]


def test_factorisation_with_metadata_equals_the_sum_over_pairs():
    rng = np.random.default_rng(6)
    inputs = quality.Reader().read(["a b b c", "", "a"], [(3, "x"), (None, "x"), (3, "y")], ("n", "s"))
    size = quality.WORD_BUCKETS + quality.STATISTICS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)), np.zeros(quality.STATISTICS), np.full(quality.STATISTICS, 9.0))
    statistics = inputs.statistics(m)
    for i, got in enumerate(m.score(inputs)):
        mine = inputs.owner == i
        places = [*inputs.bucket[mine], *range(quality.WORD_BUCKETS, size)]
        x = np.array([*inputs.value[mine], *statistics[i]])
        want = 0.3 + m.linear[places] @ x
        want += sum(x[a] * x[b] * (m.factors[places[a]] @ m.factors[places[b]]) for a in range(len(x)) for b in range(a + 1, len(x)))
        assert got == pytest.approx(want)
    assert [(inputs.owner == i).sum() for i in range(3)] == [5, 2, 3]
