"""Sentence pieces against the library, and batches of merges against single ones."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from epicell.llm import queries, sentence_pieces
from epicell.llm.batch_merge import LONGEST, PairTable, merge_all

library = pytest.importorskip("sentencepiece")

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "▁", "\n", "\n\n", "\t", "\r", "\x00", "\x1c", "\xa0", "　", "a", "the", "B", "é", "́", "中", "の", "\U0001f600", "\U0010ffff"]
ODD += ["<s>", "</s>", "<0x0A>", "<unk>", "1", "'", " t", "ing", "​", "‍", "ß"]


@pytest.fixture(scope="module")
def theirs():
    return library.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.PieceModel.load(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    return made + ["", " ", "\n", "a" * 5000, " " * 3000, "\n" * 70, "the" * 2000, "▁" * 99, "The end of it."]


def rows_of(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@pytest.mark.parametrize("end", [True, False])
def test_ids_are_the_library_s(theirs, model, texts, end):
    encoder = sentence_pieces.PieceEncoder(model)
    want = theirs.encode(texts, add_eos=end)
    for at in range(0, len(texts), 700):
        assert rows_of(*encoder.encode(texts[at : at + 700], end)) == want[at : at + 700]
    assert rows_of(*encoder.encode([], end)) == []


def test_single_merges_equal_batches(model, texts):
    agenda = sentence_pieces.Agenda(model)
    split, _ = sentence_pieces.stretches(model)
    parts = sorted({p for t in texts for p in split.findall(t.replace(" ", "▁"))})
    ids, sizes = agenda.encode_all(parts)
    assert rows_of(ids, np.concatenate([[0], np.cumsum(sizes)])) == [agenda.encode(p) for p in parts]


def test_trimming_the_memory_changes_nothing(model, texts, monkeypatch):
    encoder = sentence_pieces.PieceEncoder(model)
    want = rows_of(*encoder.encode(texts[:40]))
    monkeypatch.setattr(sentence_pieces, "REMEMBERED_STRETCHES", 10)
    assert [rows_of(*encoder.encode([t]))[0] for t in texts[:40]] == want


def test_decoding_any_ids(theirs, model, texts):
    rng = random.Random(2)
    some = [0, 1, 2, 259, 260, 28705, *range(3, 259), *[rng.randrange(32_000) for _ in range(300)]]
    rows = [[rng.choice(some) for _ in range(rng.randint(0, 12))] for _ in range(8000)] + theirs.encode(texts, add_eos=True)
    flat = np.array([i for r in rows for i in r])
    decoder = sentence_pieces.PieceDecoder(model)
    got = decoder.decode(flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])])).to_pylist()
    assert got == [theirs.decode(r) for r in rows]
    with pytest.raises(ValueError):
        decoder.decode(np.array([32_000]), np.array([0, 1]))


def tiny(kinds=(), **more):
    pieces = ["<unk>", "</s>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁ab", "b▁", "b▁a"]
    kinds = {"<unk>": 2, "</s>": 3, **dict(kinds)}
    scores = [-float(i) for i in range(len(pieces))]
    m = sentence_pieces.PieceModel(pieces, scores, [kinds.get(p, 1) for p in pieces], **more)
    m.ids = {p: i for i, p in enumerate(pieces)}
    return m


def pieces_of(m, text):
    ids, bounds = sentence_pieces.PieceEncoder(m).encode([text], end=False)
    return [m.pieces[i] for i in ids]


def test_kinds_of_pieces():
    assert pieces_of(tiny(), "abc") == ["▁", "abc"]  # ab is the best pair, then abc scores better than ▁ab
    assert pieces_of(tiny({"ab": 5, "▁ab": 5}.items()), "ab") == ["▁", "a", "b"]  # out of use: what it was made of
    assert pieces_of(tiny({"bc": 4}.items()), "abc") == ["▁", "a", "bc"]  # defined by the user: never merged
    assert pieces_of(tiny(), "z") == ["▁", "<unk>"]
    assert pieces_of(tiny(dummy_prefix=False), "b ab") == ["b", "▁ab"]
    assert pieces_of(tiny(dummy_prefix=False), "b a b") == ["b▁a", "▁", "b"]  # a blank inside a piece: no stretches


def test_other_vocabularies_are_refused(tmp_path):
    file = tmp_path / "other.model"
    file.write_bytes(b"")
    with pytest.raises(ValueError):
        sentence_pieces.PieceModel.load(str(file))


def test_pair_table_and_merges():
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 60, 900), rng.integers(0, 60, 900)
    keys = np.unique(left << 32 | right)
    rng.shuffle(keys)
    left, right = keys >> 32, keys & 0xFFFFFFFF
    ranks = rng.integers(0, 50, len(keys))  # ties in rank go to the leftmost
    results = rng.integers(0, 60, len(keys))
    table = PairTable(left, right, ranks, results)
    known = {(a, b): (r, x) for a, b, r, x in zip(left.tolist(), right.tolist(), ranks.tolist(), results.tolist())}
    rows = [rng.integers(-1, 60, n).tolist() for n in [0, 1, 2, LONGEST, *rng.integers(0, LONGEST, 400)]]
    symbols, bounds = merge_all(table, np.array([s for r in rows for s in r]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for row, got in zip(rows, rows_of(symbols, bounds)):
        while True:
            options = [(known[p][0], i) for i, p in enumerate(zip(row, row[1:])) if p in known]
            if not options:
                break
            i = min(options)[1]
            row[i : i + 2] = [known[tuple(row[i : i + 2])][1]]
        assert got == row
    with pytest.raises(ValueError):
        merge_all(table, np.zeros(LONGEST + 1, dtype=int), np.array([0, LONGEST + 1]))


def test_awkward_rows(spark, odd, nothing, theirs):
    rows = sentence_pieces.decode(sentence_pieces.encode(odd, PATH), PATH).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.ids == theirs.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "")
    assert sentence_pieces.decode(sentence_pieces.encode(nothing, PATH), PATH).count() == 0
    broken = spark.createDataFrame([(1, [243, 131]), (2, None), (3, []), (4, [5, None, 260])], "i int, ids array<int>")
    got = {r.i: r.decoded for r in sentence_pieces.decode(broken, PATH).collect()}
    assert got == {1: theirs.decode([243, 131]), 2: "", 3: "", 4: theirs.decode([5, 260])}


def test_a_difference_from_the_library_is_an_error(theirs):
    with pytest.raises(ValueError, match="other ids"):
        sentence_pieces._compare(theirs, ["a b"], np.array([264, 2]), np.array([0, 2]), True)


def test_query_equals_the_library(spark, folder, theirs):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op12_sentence_pieces(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
