"""Line templates, near duplicates, archives and the job, against plain versions."""

import base64
import hashlib
import random
import re
import struct

import duckdb
import pyarrow.fs
import pytest

import corpus_pipeline
from epicell.llm import line_templates, ngram_join, queries, warc
from epicell.llm.components import connected_components
from epicell.session import shared_dir
from tools.compare import TABLES, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_recurring_lines_go_but_once(spark):
    notice = "Copyright held by the authors, all rights reserved, see notice {} for the whole of it."
    rows = [(i, f"own text number of document {'abcdefgh'[i]} stays here\n" + notice.format(i * 7)) for i in range(6)]
    rows += [(6, rows[0][1]), (7, "short line\nshort line"), (8, "short line"), (9, "short line")]
    got = {r.doc_id: (r.text, r.dropped_lines) for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (rows[0][1], 0) and got[6] == got[0]
    assert all(got[i] == (rows[i][1].split("\n")[0], 1) for i in range(1, 6))
    assert got[7] == ("short line\nshort line", 0)


def test_one_half_of_a_template_may_vary(spark):
    head = "This page of the common handbook was last edited by"
    rows = [(i, f"{head} {w} {w}x who lives in {w}ville") for i, w in enumerate(["anna", "bert", "carl", "dora"])]
    rows += [(9 + i, f"In this paper we show {w} and {w}s") for i, w in enumerate(["trees", "lists", "maps", "sets"])]
    assert line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("dropped_lines = 1").count() == 3


def line_stage(spark, folder, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in corpus_pipeline.without_recurring_lines(spark, docs, folder).collect()}


def test_job_drops_long_lines_of_two_texts(spark, folder):
    passage = " ".join(f"{w}ing" for w in "abcdefghijklmnopqrst")
    varied = passage.replace("king", "other")
    texts = [f"first own line\n{passage}", f"second own line\n{passage}", f"third own line\n{varied.replace('ting', 'end')}", "four tokens stand here", "four tokens stand here\nx"]
    got = line_stage(spark, folder, texts)
    assert got[0] == texts[0] and got[1] == "second own line"
    assert [got[i] for i in (2, 3, 4)] == texts[2:]


def test_job_drops_verbatim_repeats_of_any_form(spark, folder):
    repeats = ["All rights reserved.", "17 18 19 20 total", "文" * 20, "}"]
    texts = [f"own line of text {w}\n" + "\n\n".join(repeats) for w in ("one", "two", "three")]
    long = "字" * 120
    texts += [f"just two of these\n{long}", f"two of these again\n{long}", "Short line\nonce", "Short line\ntwice"]
    got = line_stage(spark, folder, texts)
    assert got[0] == texts[0] and got[3] == texts[3] and got[4] == "two of these again"
    assert [got[i] for i in (1, 2)] == [f"own line of text {w}\n\n\n" for w in ("two", "three")]
    assert [got[i] for i in (5, 6)] == texts[5:]


def test_awkward_lines(odd, nothing):
    rows = line_templates.drop_recurring_lines(odd).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == set(odd.columns)
    assert next(r for r in rows if r.doc_id == 2).text is None
    assert all(r.text == t for r in rows for t in [next(x[1] for x in odd.select("doc_id", "text").collect() if x[0] == r.doc_id)])
    assert line_templates.drop_recurring_lines(nothing).count() == 0


def plain_links(rows):
    word = re.compile(r"\w+")
    sets = []
    for _, text in rows:
        w = word.findall((text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            best[find(i)] = min(best.get(find(i), key), key)
    return sorted(((k, best.get(find(i)), links[i]) for i, (k, _) in enumerate(rows)), key=str)


def near_copies(seed, texts, changes):
    rng = random.Random(seed)
    rows = []
    for group in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(200)]
        for _ in range(texts):
            words = list(base)
            for _ in range(rng.randrange(changes)):
                words[rng.randrange(200)] = f"x{rng.randrange(500)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("tile", [1024, 7])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "BUCKET_TEXTS", tile)
    monkeypatch.setattr(ngram_join, "CLASS_TEXTS", tile)
    rows = near_copies(1, 25, 12) + [(900, None), (901, ""), (902, "one two"), (903, "One, two!"), (904, "?!"), (904, "?!"), (None, "one two")]
    rows += [(905 + i, "same text of six words here") for i in range(40)]
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, signature string, part int").repartition(5)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.link_documents(df).collect()), key=str)
    assert got == plain_links(rows)
    kept = [r.doc_id for r in ngram_join.keep_one_of_each(df).collect()]
    classes = {c for k, c, _ in got if k is not None and k < 900}
    assert sorted(k for k in kept if k < 900) == sorted(classes)
    assert sorted(k for k in kept if k >= 900) == [900, 901, 902, 904, 905]


def test_copies_without_words_are_one_class(spark):
    texts = ["", "?!", "", None, "?!", "", None, " ?!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.link_documents(df).collect()}
    assert got == {i: (c, 0) for i, c in enumerate([0, 1, 0, 3, 1, 0, 6, 7])}
    assert sorted(r.doc_id for r in ngram_join.keep_one_of_each(df).collect()) == [0, 1, 3, 6, 7]


def test_near_duplicates_of_awkward_rows(odd, nothing):
    assert ngram_join.link_documents(odd).count() == odd.count()
    kept = ngram_join.keep_one_of_each(odd)
    assert set(kept.columns) == set(odd.columns)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 8, 9]
    assert ngram_join.link_documents(nothing).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    floors = ngram_join.least_matches()
    assert floors[0] == 0 and all(a <= b for a, b in zip(floors, floors[1:]))
    assert floors[-1] < 0.8 * ngram_join.HASHES


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(5, 5), (None, 3)] + [(300 + rng.randrange(80), 300 + rng.randrange(80)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_archives_hold_dictionary_and_records(spark):
    html = ["<html>" + "row of a table " * 30 + str(i % 40) + "</html>" for i in range(600)] + [None, "", "x" * 200_000, "é\r\n\r\nWARC/1.1"]
    rows = [(i, f"http://a/{i}\r\nX: 1" if i % 3 else None, h) for i, h in enumerate(html)] + [(None, "u", html[0]), (-5, "u", "only"), (2**62 + 9, "u", html[1])]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = shared_dir(spark, "warc")
    manifest = warc.write_archives(pages, folder)
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    for row in manifest.collect():
        with system.open_input_file(f"{path}/{row.archive}") as f:
            magic, size = struct.unpack("<II", f.read(8))
        assert magic == warc.DICTIONARY_MAGIC and size > 1000
    got = warc.read_archives(manifest, folder).collect()
    best = {}
    for key, _, text in rows:
        if key is not None:
            best[text or ""] = max(best.get(text or "", key), key)
    want = set()
    for key, _, text in rows:
        body = (text or "").encode()
        first = best.get(text or "")
        want.add((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if key == first else "revisit", None if key == first else first))
    assert len(got) == len(rows)
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    texts = {k: t for k, _, t in rows}
    assert all(bytes(r.payload) == (texts[r.page_id] or "").encode() for r in got if r.record_type == "response")


def test_few_pages_and_none(spark):
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    assert [(r.page_id, bytes(r.payload)) for r in warc.round_trip(spark, pages).collect()] == [(1, b"a")]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_job_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        now = docs.count()
        assert 0 < now <= before
        before = now
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == ids


def test_stages_take_awkward_rows(spark, folder, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() > 0
        assert stage(spark, docs.limit(0), folder).count() == 0
