"""Nearest neighbours against all inner products."""

import numpy as np
import pytest

from docweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, asked, k):
    out = {}
    for q, v in asked:
        near = sorted((-float((np.array(v, float) * np.array(w, float)).sum()), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(60)] + [(2000, [1.0, 2.0]), (2001, [2.0, 1.0])]
    bad = [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] + [1.0] * 7), (5003, [float("inf")] + [1.0] * 7), (5004, [None] + [1.0] * 7), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad + rows[:5]], SCHEMA)
    got = collect(ann.nearest_neighbours(table.filter("vec_id % 20 = 0"), table, 20, search=ann.Search(sure=0.999999)))
    want = brute(rows, [(i, v) for i, v in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 700)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32))
    v = (centres[rng.integers(0, 12, 2500)] + 0.6 * rng.normal(size=(2500, 32))).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(v)], SCHEMA)
    got = collect(ann.nearest_neighbours(table.filter("vec_id % 20 = 0"), table, 20))
    want = brute(list(enumerate(v.tolist())), [(i, v[i]) for i in range(0, 2500, 20)], 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert ann.nearest_neighbours(table.filter("false"), table, 20).count() == 0
    assert ann.nearest_neighbours(table.limit(3), table.filter("false"), 20).count() == 0


@pytest.mark.parametrize("spread, most", [(0.25, 0.2), (0.6, 0.6), (None, 0.85)])
def test_the_projection_spares_inner_products(spread, most):
    """Clusters of narrow and wide spread, and vectors without any: enough neighbours are found, and not all vectors are verified."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(4000, 32)) if spread is None else rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + spread * rng.normal(size=(4000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    block = ann.Block(np.arange(4000), v, ann.Search())
    asked = block.vectors[::20]
    got, want = block.nearest(asked, 20), np.argsort(-(asked @ block.vectors.T), axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got.tolist(), want.tolist())])
    assert recall >= 0.9 and block.verified / (len(asked) * 4000) <= most, (recall, block.verified / (len(asked) * 4000))


def test_chi_square_point():
    assert abs(ann.chi_square_point(0.95, 10) - 18.307) < 1e-3 and abs(ann.chi_square_point(0.5, 2) - 1.38629) < 1e-4
