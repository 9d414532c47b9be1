"""Encoding, decoding and packing against the tokenizers library."""

import os
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

from epicell.llm import lexicon_bpe, packing
from epicell.llm.bpe import Vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"
tokenizers = pytest.importorskip("tokenizers")

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [" ", "  ", "\n", "\t", "\r", "\xa0", " ", "\x1c", "\x85", "　", "a", "B", "é", "ß", "中", "1", "٣", "½", "!", "'s", "'LL", "'", "<|endoftext|>", "<|", "́", "‍", "\U0001f600", "_", "\x00", "İ", "ǅ", "Ᲊ", "࢏"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    return made + ["", "a  ", "ab" * 3000, "x" * 500, "\n a", "a\n \nb", " a", "a  b", "the " * 200]


def test_automaton_numbers_words_and_refuses_others():
    words = sorted({bytes(random.Random(i).choices(b"abcd", k=i % 7 + 1)) for i in range(3000)})
    a = lexicon_bpe.Automaton.compile(words)
    assert a.find(words).tolist() == list(range(len(words)))
    assert (a.find([w + b"!" for w in words] + [b"", b"zz"]) == -1).all()
    assert len(lexicon_bpe.Automaton.compile([b"ax", b"bx", b"cx"]).base) == 3  # ends are shared


@pytest.mark.parametrize("words", [[], ["the", " the", "\n"], None])
def test_ids_are_the_library_s_whatever_the_lexicon(texts, words):
    library, vocabulary = tokenizers.Tokenizer.from_file(BYTE), Vocabulary.load(BYTE)
    splitter = lexicon_bpe.Splitter(vocabulary.special)
    if words is None:
        words = {w for t in texts for w in splitter.words(t)}
    lexicon = lexicon_bpe.Lexicon.mapped(lexicon_bpe.Lexicon.compile(words, vocabulary))
    encoder = lexicon_bpe.Encoder(lexicon, vocabulary, splitter)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, bounds = encoder.encode(part)
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_trimming_the_memory_changes_nothing(texts, monkeypatch):
    vocabulary = Vocabulary.load(BYTE)
    encoder = lexicon_bpe.Encoder(lexicon_bpe.Lexicon.mapped(lexicon_bpe.Lexicon.compile([], vocabulary)), vocabulary, lexicon_bpe.Splitter(vocabulary.special))
    want = [encoder.encode([t])[0].tolist() for t in texts[:300]]
    monkeypatch.setattr(lexicon_bpe, "REMEMBERED_PIECES", 20)
    assert [encoder.encode([t])[0].tolist() for t in texts[:300]] == want
    words = packing.WordEncoder(WORD)
    want = [x.tolist() for x in words.encode(texts[:300])]
    monkeypatch.setattr(packing, "REMEMBERED_CHUNKS", 20)
    assert [words.encode([t])[0].tolist() for t in texts[:300]] == want


def test_word_ids_are_the_library_s(texts):
    encoder = packing.WordEncoder(WORD)
    texts = texts + [f"a{chr(c)}1 {chr(c)}!{chr(c)}" for c in range(0x300)]
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_of_awkward_rows(odd, nothing):
    vocabulary = Vocabulary.load(BYTE)
    lexicon = lexicon_bpe.build_lexicon(odd, vocabulary, size=50)
    rows = lexicon_bpe.decode(lexicon_bpe.encode(odd, lexicon, vocabulary), vocabulary).collect()
    assert len(rows) == odd.count()
    assert all(r.decoded == (r.text or "") for r in rows)
    assert lexicon_bpe.encode(nothing, lexicon, vocabulary).count() == 0
    assert lexicon_bpe.build_lexicon(nothing, vocabulary)


def test_decoding_broken_ids(spark):
    library, vocabulary = tokenizers.Tokenizer.from_file(BYTE), Vocabulary.load(BYTE)
    cases = [[162, 250], [50256, 0], [], None, [220, 99999, 5]]
    rows = lexicon_bpe.decode(spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<int>"), vocabulary).collect()
    assert {r.i: r.decoded for r in rows} == {i: library.decode(c or [], skip_special_tokens=False) for i, c in enumerate(cases)}


def counted(documents):
    out = defaultdict(int)
    for row in documents.collect():
        out[row.doc_id] += 1
    return out


def check_packed(documents, sequences, window):
    library = tokenizers.Tokenizer.from_file(WORD)
    held = defaultdict(list)
    for row in sequences.collect():
        assert 0 < row.n_tokens <= window and row.n_tokens == len(row.ids) // 4
        at = 0
        for p in row.pieces:
            assert p.offset == at
            held[p.doc].append((p.start, bytes(row.ids[4 * at : 4 * (at + p.length)]), p.doc_tokens))
            at += p.length
        assert at == row.n_tokens
    tokens = 0
    for row in documents.select("doc_id", "text").distinct().collect():
        n = counted(documents)[row.doc_id]
        ids = library.encode(row.text or "", add_special_tokens=False).ids + [2]
        whole = b"".join(i.to_bytes(4, "little") for i in ids)
        pieces = sorted(held[row.doc_id])
        assert sum(len(b) for _, b, _ in pieces) == n * len(whole)
        assert all(whole[4 * s : 4 * s + len(b)] == b and t == len(ids) for s, b, t in pieces)
        tokens += n * len(ids)
    return tokens


@pytest.mark.parametrize("window, most", [(64, 2), (4096, 64)])
def test_packing_loses_nothing(spark, folder, odd, window, most):
    for documents in (odd, spark.read.parquet(f"{folder}/documents.parquet").repartition(5)):
        sequences = packing.pack(documents, WORD, window=window, open_windows=most, min_cut=8)
        tokens = check_packed(documents, sequences, window)
        padding = sum(window - r.n_tokens for r in sequences.select("n_tokens").collect() if r.n_tokens & (r.n_tokens - 1))
        assert padding <= 0.1 * tokens
        assert sequences.select("sequence_id").distinct().count() == sequences.count()


def test_packing_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_WINDOWS", 2)
    documents = spark.range(60).selectExpr("id as doc_id", "repeat('the land ', cast(id as int)) as text").repartition(9)
    check_packed(documents, packing.pack(documents, WORD, window=32, open_windows=3), 32)


def test_packing_nothing(nothing):
    assert packing.pack(nothing, WORD).count() == 0


def test_digests(spark):
    documents = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = packing.piece_digests(packing.pack(documents, WORD)).orderBy("start").collect()
    ids = tokenizers.Tokenizer.from_file(WORD).encode("hello world", add_special_tokens=False).ids + [2]
    data = b"".join(i.to_bytes(4, "little") for i in ids)
    assert [r.ids_crc32 for r in row] == [zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) for r in row]
