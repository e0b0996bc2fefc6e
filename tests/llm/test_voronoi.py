"""Exact top-k against brute force, hot cells, and defined cases."""

import math

import numpy as np
import pytest

from docskein.llm import voronoi


def brute(rows, k=10, of=lambda i: i % 100 == 0):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in fine:
        if of(i):
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -d) for r, (d, j) in enumerate(s[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def f32(v):
    return [None if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(voronoi, "ROWS_PER_PIECE", 150)
    monkeypatch.setattr(voronoi, "QUERIES_PER_BLOCK", 2)
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, 12))
    rows = [(i, f32(centre[int(rng.integers(0, 8))] + rng.normal(size=12) * (0.01 if i % 3 else 1))) for i in range(900)]
    rows = [(i, rows[0][1] if i % 4 == 0 else v) for i, v in rows]  # a quarter is one vector
    d = frame(spark, rows)
    got = {tuple(r) for r in voronoi.top_k(d.filter("vec_id % 100 = 0"), d, pivots=16).collect()}
    assert got == brute(rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (300, [nan, 1.0]), (400, [inf, 1.0]), (1, [None, 1.0]), (2, [3.0, -1.0]),
            (3, []), (500, [1.0, 1.0, 1.0]), (4, [2.0, 2.0, 0.5]), (None, [1.0, 1.0]), (5, [-0.0001, 0.3])]
    d = frame(spark, rows)
    got = {tuple(r) for r in voronoi.top_k(d.filter("vec_id % 100 = 0"), d).collect()}
    assert got == brute([(i, f32(v) if v else v) for i, v in rows]) and {g[0] for g in got} == {0, 100, 500}
    assert voronoi.top_k(d.limit(0), d).count() == 0 and voronoi.top_k(d.limit(0), d.limit(0)).count() == 0
    twice = frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0])])
    got = sorted(tuple(r) for r in voronoi.top_k(twice.filter("vec_id = 0"), twice).collect())
    assert [g[1:3] for g in got] == [(1, 2), (2, 1), (3, 1)]
    big = frame(spark, [(0, [1e10, 3.0]), (1, [1e2, 5.0]), (2, [1e2, 4.0])])
    got = {tuple(r) for r in voronoi.top_k(big.filter("vec_id = 0"), big).collect()}
    assert got == brute([(0, f32([1e10, 3.0])), (1, [1e2, 5.0]), (2, [1e2, 4.0])])


def test_repeated_rows_of_the_query(spark):
    rng = np.random.default_rng(4)
    rows = [(0, f32([1.0, 0.1]))] * 12 + [(i, f32(rng.normal(size=2))) for i in range(1, 21)]
    d = frame(spark, rows)
    scores = sorted((sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(rows[0][1], v)) for i, v in rows if i), reverse=True)[:10]
    got = [tuple(r) for r in voronoi.top_k(d.filter("vec_id % 100 = 0").limit(1), d).collect()]
    assert [s for *_, s in sorted(got, key=lambda r: r[1])] == scores
    got = voronoi.top_k(d.filter("vec_id % 100 = 0"), d).collect()
    assert len(got) == 120 and sorted(r.score for r in got) == sorted(scores * 12)
