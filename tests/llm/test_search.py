"""Vector searches against brute force."""

import numpy as np
import pytest

from epicell.llm import bit_slices, blocks, rotated_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id int, block int, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Random vectors of several lengths with ties, copies, repeated rows, zero, NULL and broken ones, and clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 19).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    rows += [(2000, [0.0] * 19), (2020, None), (2040, [float("nan")] * 19), (2060, [None] + [0.1] * 18), (2080, []), (None, rows[3][1])]
    # other lengths: three vectors of one, and one alone
    rows += [(2100, [0.5] * 7), (2120, [0.25] * 7), (2121, [-0.5] * 7), (2140, [1.0, 2.0])]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(4)


def brute(vectors, every, k, change, with_zero):
    rows = {}
    for r in vectors.collect():
        v = r.embedding
        if r.vec_id is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        if with_zero or any(v):
            rows[r.vec_id] = change(np.array(v, dtype=float))
    ids = sorted(rows)
    out = set()
    for q in ids:
        if q % every == 0:
            scored = sorted((-(rows[q] * rows[i]).sum(), i) for i in ids if i != q and len(rows[i]) == len(rows[q]))[:k]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("size", [8192, 50])
def test_bit_slices_are_exact(vectors, monkeypatch, size):
    monkeypatch.setattr(bit_slices, "BLOCK_ROWS", size)
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", size)
    got = {tuple(r) for r in bit_slices.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()}
    assert got == brute(vectors, 20, 5, lambda v: np.floor(256 * v).astype(int), True)


@pytest.mark.parametrize("size", [8192, 50])
def test_rotated_codes_find_the_nearest(vectors, monkeypatch, size):
    monkeypatch.setattr(rotated_codes, "BLOCK_ROWS", size)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in rotated_codes.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()}
    want = {(q, rank): (i, s) for q, rank, i, s in brute(vectors, 20, 20, lambda v: v, False)}
    assert got.keys() == want.keys()
    hits = [got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want]
    assert np.mean(hits) >= 0.98


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 64))
    rotation = rotated_codes.Rotation.random(v.mean(axis=0))
    code, length, aligned, with_centre = rotation.encode(v)
    block = {"id": np.arange(3000), "vector": v, "code": code, "length": length, "aligned": aligned, "with_centre": with_centre}
    found = rotated_codes.search_block(block, np.array([5]), v[5:6], rotation, 20)[0]
    exact = v @ v[5]
    exact[5] = -np.inf
    assert set(found[1]) == set(np.argsort(-exact)[:20])
    product, rounding = rotated_codes.sign_products(rotated_codes.words(code), v[0] @ rotation.matrix)
    signs = np.where(np.unpackbits(code, axis=1, bitorder="little")[:, :64], 1, -1)
    assert (np.abs(product - signs @ (v[0] @ rotation.matrix)) <= rounding + 1e-9).all()


def test_fewer_candidates_than_asked(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (20, [0.5, -1.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.vec_id) for r in rotated_codes.nearest(two, two).collect()} == {(0, 20), (20, 0)}
    assert {tuple(r) for r in bit_slices.top_k(two, two).collect()} == {(0, 1, 20, -98304), (20, 1, 0, -98304)}
    for run in (rotated_codes.nearest, bit_slices.top_k):
        assert run(two.limit(0), two.limit(0)).count() == 0
        assert run(two.limit(1), two.limit(0)).count() == 0
