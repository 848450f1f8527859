"""Whitening: the polynomial and its roots against exact arithmetic, components against numpy, results against a plain loop."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from tagmill.llm import queries
from tagmill.llm import whitening as w

D = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, n string, component int"


def exact_polynomial(matrix: list[list[int]]) -> list[int]:
    """Faddeev and Le Verrier's recurrence in fractions."""
    d = len(matrix)
    a = np.array([[Fraction(c) for c in row] for row in matrix], object)
    m, found = np.full((d, d), Fraction(0), object), [Fraction(1)]
    unit = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        m = a @ m + found[-1] * unit
        found.append(-sum((a @ m)[i, i] for i in range(d)) / k)
    return [int(c) for c in reversed(found)]


def gram(x: np.ndarray) -> list[list[int]]:
    wide = x.astype(object)
    return [[int(c) for c in row] for row in wide.T @ wide]


@pytest.mark.parametrize("d", [1, 2, 3, 6])
def test_polynomial_is_exact(spark, d):
    rng = np.random.default_rng(d)
    for size in (50, 10**6):
        matrix = gram(rng.integers(-size, size, (d + 2, d)))
        assert w.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)
    singular = gram(rng.integers(-9, 9, (1, d)))
    assert w.characteristic_polynomial(spark, singular) == exact_polynomial(singular)
    diagonal = [[7 * int(i == j) for j in range(d)] for i in range(d)]
    assert w.characteristic_polynomial(spark, diagonal) == exact_polynomial(diagonal)


def times(*roots: Fraction) -> list[int]:
    poly = [Fraction(1)]
    for r in roots:
        poly = [a - r * b for a, b in zip([Fraction(0), *poly], [*poly, Fraction(0)], strict=True)]
    return w._whole(poly)


def test_roots_are_counted_parted_and_narrowed():
    roots = [Fraction(9), Fraction(9), Fraction(9), Fraction(25, 3), Fraction(25, 3) - Fraction(1, 10**12), Fraction(1, 7), Fraction(0), Fraction(0)]
    poly = times(*roots)
    assert w.square_free(poly) in (times(*set(roots)), [-c for c in times(*set(roots))])
    for at in (0, 1, 8, 9, 10):
        assert w.roots_above(poly, at, 0) == sum(r > at for r in roots)
    found = w.largest_roots(poly, 16)
    assert [r.times for r in found] == [3, 1, 1, 1]
    for root, true in zip(found, [roots[0], roots[3], roots[4], roots[5]], strict=True):
        assert Fraction(root.low, 1 << root.bits) < true <= Fraction(root.high, 1 << root.bits)
        assert abs(root.narrowed(w.square_free(poly), 200).middle() - true) <= Fraction(1, 1 << 199)


def test_repeated_and_close_eigenvalues(spark):
    """A rotated diagonal with a threefold, two nearly equal and a zero eigenvalue: vectors stand upright on each other and satisfy the equation."""
    turn = np.array([[int(c) for c in row] for row in [[1, 1, 1, 1, 0, 0], [1, -1, 1, -1, 0, 0], [1, 1, -1, -1, 0, 0], [1, -1, -1, 1, 0, 0], [0, 0, 0, 0, 2, 0], [0, 0, 0, 0, 0, 2]]], object)
    values = [10**15, 10**15, 10**15, 10**9 + 1, 10**9, 0]
    matrix = [[int(c) for c in row] for row in turn @ np.diag(np.array(values, object)) @ turn.T]
    vectors, found = w.components(spark, matrix)
    assert [round(float(v)) for v in found] == [4 * 10**15] * 3 + [4 * (10**9 + 1), 4 * 10**9]
    v = np.array(vectors)
    assert np.abs(v @ v.T - np.eye(5)).max() < 1e-15
    for row, value in zip(vectors, found, strict=True):
        exact = [sum(Fraction(c) * m for c, m in zip(row, line, strict=True)) - Fraction(value) * Fraction(row[i]) for i, line in enumerate(matrix)]
        assert max(abs(e) for e in exact) < value / 10**6 if value < 10**12 else max(abs(e) for e in exact) < value / 10**14
    assert np.abs(v[3]).max() == pytest.approx(1.0 if abs(v[3][4]) > 0.9 else 0.5, abs=1e-15)


def plain(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """vec_id to (n, deviation) by a loop."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = {tuple(x) for _, x in good}
    sums = [sum(col) for col in zip(*fit, strict=True)]
    return {i: (len(fit), sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in good}


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{D}/embeddings.parquet")
    source = [(r.vec_id, list(map(float, r.embedding))) for r in table.collect()]
    out = queries.op12_whitening(spark, D)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = {(r.vec_id, r.component): r for r in out.collect()}
    want = plain(source)
    assert got.keys() == {(i, c) for i in want for c in range(1, 17)}
    x = np.floor(64 * np.array([v for _, v in source]))
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    mean, ids = fit.mean(0), [i for i, _ in source]
    for c in range(1, 17):
        mine = np.array([got[i, c].whitened for i in ids])
        theirs = (x - mean) @ vectors[:, -c] / math.sqrt(values[-c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-9
        assert got[ids[0], c].explained == pytest.approx(values[-c] / values.sum(), rel=1e-9)
    assert all((r.n, r.deviation) == want[i] and r.identity_error < 1e-9 for (i, _), r in got.items())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=4)], "x", i) for i in range(30)]
    rows += [(i + 100, rows[i][1], "x", 1) for i in range(30)]  # copies
    rows += [(0, rows[5][1], None, None), (None, rows[6][1], "x", 1), (200, [0.0, 0.0, 0.0, 0.0], "x", 1)]
    odd = [(300, None, "x", 1), (301, [1.0, None, 2.0, 3.0], "x", 1), (302, [1.0, float("nan"), 2.0, 3.0], "x", 1), (303, [float("-inf"), 0.0, 1.0, 2.0], "x", 1), (304, [], "x", 1), (305, [1.0, 2.0], "x", 1)]
    out = w.whiten(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    want = plain(rows)
    assert {r.vec_id for r in out} == set(want) and len(out) == 4 * len(rows)
    assert all(r.n == 31 for r in out) and all((r.n, r.deviation) == want[r.vec_id] for r in out if r.vec_id)
    fit = np.array([[r.whitened for r in sorted(out, key=lambda r: r.component) if r.vec_id == i] for i in [*range(1, 30), 200]])
    assert np.isfinite(fit).all() and max(r.identity_error for r in out) < 1e-12
    assert w.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert w.whiten(spark.createDataFrame(odd[:5], SCHEMA)).collect() == []
    assert w.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", 1), (2, [1.0, 2.0], "x", 1)], SCHEMA)).collect() == []
    line = w.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "x", 1) for i in range(5)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and line[0].explained == 1.0


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e17, 0.0], "x", 1), (2, [0.0, 1.0], "x", 1), (3, [-1e17, 5.0], "x", 1), (4, [1e300, 0.0], "x", 1)]
    out = w.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 8 and {r.n for r in out} == {3} and all((r.deviation is None) == (r.vec_id != 2) for r in out)
    assert all(math.isfinite(r.whitened) and r.identity_error < 1e-9 for r in out)
    sums = w.exact_sums(spark.createDataFrame([([2**40 + 1_000_000, -(2**40) + 1_000_000],), ([3 + 1_000_000, 1_000_000],)], "x array<long>"), 2)
    assert sums == (2, [2**40 + 3, -(2**40)], [[2**80 + 9, -(2**80)], [-(2**80), 2**80]])
