"""Whitening against a dense eigenvalue solver and exact whole numbers."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import catalog, whitening

SF = "/root/testdata/sf0.001"


def check(got, rows, k=4):
    """``got`` against a dense solver; ``rows`` are (vec_id, whole numbers), ids differ."""
    fit = np.array(sorted({tuple(x) for _, x in rows}), np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    of = defaultdict(dict)
    for r in got:
        of[r.vec_id][r.component] = r
    assert set(of) == {i for i, _ in rows} and len(got) == k * len(rows)
    sign = {}
    for i, x in rows:
        assert sorted(of[i]) == list(range(1, k + 1))
        for c, r in of[i].items():
            assert r.n == n and r.deviation == sum((n * int(v) - s) ** 2 for v, s in zip(x, sums))
            assert math.isclose(r.explained, e[c - 1] / np.trace(cov), rel_tol=1e-10) and 0 <= r.identity_error < 1e-9
            want = (np.array(x) - np.array(sums) / n) @ u[:, c - 1] / math.sqrt(e[c - 1])
            if abs(want) > 1e-3:
                sign.setdefault(c, np.sign(want) * np.sign(r.whitened))
            assert abs(want - sign.get(c, 1) * r.whitened) < 1e-8


def test_registered_query_against_a_dense_solver(spark):
    rows = [(r.vec_id, [math.floor(256 * c) for c in r.embedding]) for r in catalog.table(spark, SF, "embeddings").collect()]
    check(catalog.op13_jacobi_davidson_whitening(spark, SF).collect(), rows)


def test_copies_count_once_and_odd_rows_are_dropped(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.normal(size=6) * [3, 1, 1, 1, .1, 2]]) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(40)]
    odd = [(200, None), (201, []), (202, [1.0] * 5), (203, [None] + [1.0] * 5), (204, [float("nan")] + [1.0] * 5), (205, [float("-inf")] + [1.0] * 5)]
    frame = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit(c) for c in ("x", "n", "component", "block", "deviation", "i", "v")})
    got = whitening.whiten(frame).collect()
    check(got, [(i, [math.floor(256 * c) for c in v]) for i, v in good])
    assert whitening.whiten(frame.where("false")).collect() == []
    assert whitening.whiten(frame.where("vec_id = 201")).collect() == []
    assert whitening.whiten(frame.where("vec_id >= 100 AND vec_id < 140")).collect() == []  # all equal: nothing varies
    twice = whitening.whiten(frame.where("vec_id < 30").union(frame.where("vec_id < 30"))).collect()
    assert len(twice) == 240 and twice[0].n == 30


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0, 1.0, -0.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(got, [(i, [math.floor(256 * c) for c in v]) for i, v in rows], k=1)
    small = [(i, [float(i % 3), float(i % 5)]) for i in range(15)]
    check(whitening.whiten(spark.createDataFrame(small, "vec_id long, embedding array<float>")).collect(),
          [(i, [math.floor(256 * c) for c in v]) for i, v in small], k=2)


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(0, [1e15, 0.0]), (1, [-1e15, 1.0]), (2, [0.0, 3.0]), (None, [5.0, 3.0]), (None, [5.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in got}[0] is None and sum(r.vec_id is None for r in got) == 2 * len({r.component for r in got})


@pytest.mark.parametrize("gap", [1.0, 1e-3, 0.0])
def test_near_and_equal_eigenvalues_settle(gap):
    rng = np.random.default_rng(7)
    turn, _ = np.linalg.qr(rng.normal(size=(150, 150)))
    e = np.concatenate([[10, 10 - gap, 10 - 2 * gap, 9, 9 - gap], rng.uniform(0, 8, 145)])
    matrix = (turn * e) @ turn.T
    values, axes = whitening.jacobi_davidson(lambda p: matrix @ p, 150, 4, 1e-13)
    assert np.abs(values - np.sort(e)[::-1][:4]).max() < 1e-11
    assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12 and np.abs(matrix @ axes - axes * values).max() < 1e-11


def test_minres_solves_each_column_as_its_own_system():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(20, 20))
    a = a + a.T + 30 * np.diag(np.sign(rng.normal(size=20)))
    b = rng.normal(size=(20, 3)) * [1, 1e-6, 1e6]
    assert np.allclose(whitening.minres(lambda t: a @ t, b, 60, 1e-12), np.linalg.solve(a, b), rtol=1e-8)
