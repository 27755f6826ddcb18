"""Both searches against all products."""

import math

import numpy as np
import pytest

from chartula.llm import exact_topk, neighbours, vector_blocks


def fixture(seed=0, size=400, dim=8):
    random = np.random.default_rng(seed)
    rows = [(int(n), [float(x) for x in v]) for n, v in enumerate(np.round(random.normal(size=(size, dim)) * 4) / 4)]
    rows += [(1000, None), (1020, [0.0] * dim), (1040, [1.0, None] + [0.0] * (dim - 2)), (1060, [math.inf] + [0.0] * (dim - 1)), (1080, [math.nan] * dim), (1100, [1.0, 2.0]), (1101, [3.0, 1.0]), (1120, []), (None, [1.0] * dim)]
    return rows + [rows[5], rows[40], rows[41]]


def brute(rows, every, k, integers):
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (integers or any(v))]
    if integers:
        usable = [(i, [math.floor(256 * x) for x in v]) for i, v in usable]
    out = set()
    for q, v in dict(usable).items():
        if q % every == 0:
            found = sorted((-(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in usable if i != q and len(w) == len(v))
            out |= {(q, n + 1, i, -s if integers else round(-s, 9)) for n, (s, i) in enumerate(found[:k])}
    return out


@pytest.fixture(params=[(4096, 1024), (64, 7)])
def small_blocks(request, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK", request.param[0])
    monkeypatch.setattr(vector_blocks, "QUERY_BLOCK", request.param[1])


def test_nearest(spark, small_blocks):
    rows = fixture()
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, dim string")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in neighbours.nearest(table, 20, 20).collect()]
    want = brute(rows, 20, 20, False)
    # Quarters multiply exactly, so ties are ties for any order of the sums.
    assert set(got) == want and len(got) == len(want)
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_exact_top_k(spark, small_blocks):
    rows = fixture(1)
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, group int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.exact_top_k(table, 50, 5).collect()]
    want = brute(rows, 50, 5, True)
    assert set(got) == want and len(got) == len(want)
    assert exact_topk.exact_top_k(table.limit(0)).count() == 0


def test_large_components(spark):
    rows = [(0, [1e15, -1e15, 3.0]), (1, [1e15, 0.0, 1.0]), (2, [-1e15, 1.0, 1.0]), (50, [1e300, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.score for r in exact_topk.exact_top_k(table).collect()}
    assert got[0, 1] == (1 << 63) - 1 and got[0, 3] == -(1 << 63)


def test_bounds_hold():
    random = np.random.default_rng(2)
    matrix = np.floor(random.normal(size=(300, 12)) * 256)
    queries = np.floor(random.normal(size=(20, 12)) * 256)
    cells, edges = exact_topk.approximation(matrix)
    place = np.arange(12)
    assert (edges[place, cells] <= matrix).all() and (matrix <= edges[place, cells + 1]).all()
    assert (exact_topk.upper_bounds(queries, cells, edges) >= queries @ matrix.T).all()
    values, scale, _ = neighbours.quantised(random.normal(size=(50, 12)))
    assert values.dtype == np.int8 and np.abs(values).max() == 127 and (scale > 0).all()
