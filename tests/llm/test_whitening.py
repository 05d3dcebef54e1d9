"""Whitening against a dense eigendecomposition."""

import math
import random

import numpy as np
import pytest

from faultline.llm import whitening

DDL = "vec_id bigint, embedding array<double>, n string, component string"


def run(spark, rows, parts=3, components=16):
    frame = spark.createDataFrame([(i, v, "n", "c") for i, v in rows], DDL).repartition(parts)
    return whitening.whiten(frame, components).collect()


def usable(rows):
    return [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]


def check(rows, found, components=16, size=None):
    kept = [(i, x) for i, x in usable(rows) if size is None or len(x) == size]
    fitted = sorted({tuple(x) for _, x in kept})
    n, total = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, total, strict=True)] for x in fitted])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors.T[::-1]
    k = min(components, int((values > 1e-15 * values[0]).sum()))
    assert len(found) == k * len(kept)
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    signs = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
        got = by_row[i, deviation]
        away = np.array([(n * a - s) / n for a, s in zip(x, total, strict=True)])
        for c in range(1, k + 1):
            want = away @ vectors[c - 1] / math.sqrt(values[c - 1])
            if abs(want) > 1e-6 and c not in signs:
                signs[c] = math.copysign(1, want) * math.copysign(1, got[c].whitened)
            assert got[c].whitened == pytest.approx(signs.get(c, 1) * want, abs=1e-7)
            assert got[c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert got[c].n == n and got[c].identity_error < 1e-8


def vectors(count, size, seed, falling=0.9):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, falling**j) + 3 * (j == 1) for j in range(size)]) for i in range(count)]


@pytest.mark.parametrize("size", [1, 5, 24])
def test_against_dense_decomposition(spark, size):
    rows = vectors(120, size, size)
    rows += [(500 + i, rows[3][1]) for i in range(60)]  # a third of all rows, once in the fit list
    rows += [(700, None), (701, []), (702, [None] * size), (703, [float("nan")] * size), (704, [float("inf")] * size), (None, rows[0][1]), (3, rows[3][1])]
    check(rows, run(spark, rows))


def test_early_convergence(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CHECK_STEPS", 2)
    rows = vectors(150, 40, 7, 0.5)
    check(rows, run(spark, rows, components=3), 3)


def test_repeated_eigenvalues(spark):
    """Unit vectors: all variances are equal, and one start vector reaches only one direction."""
    rows = [(i, [8.0 * (j == i) for j in range(12)]) for i in range(12)]
    found = run(spark, rows, components=6)
    assert len(found) == 12 * 6 and max(r.identity_error for r in found) < 1e-8
    assert all(r.explained == pytest.approx(1 / 11) for r in found)
    for i in range(12):  # the components are orthogonal: projections of two rows don't depend on the basis alone
        assert sum(r.whitened**2 for r in found if r.vec_id == i) <= 11 + 1e-6


def test_pairs_of_equal_variance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CHECK_STEPS", 1)
    rows = [(8 * j + s, [float((1 + j // 2) * s * (i == j)) for i in range(10)]) for j in range(10) for s in (-1, 1)]
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    found = run(spark, rows, components=4)
    total = sum(2 * (1 + j // 2) ** 2 for j in range(10))
    want = sorted((2 * (1 + j // 2) ** 2 / total for j in range(10)), reverse=True)[:4]
    assert [next(r.explained for r in found if r.component == c) for c in range(1, 5)] == pytest.approx(want)


def test_exact_deviation_beyond_a_long(spark):
    rows = [(0, [1e12, 0.0]), (1, [-1e12, 0.5]), (2, [3e11, 1.0])]
    assert all(r.deviation is None for r in run(spark, rows))
    rows = [(0, [2.0**23, 0.0]), (1, [-(2.0**23), 0.5]), (2, [2.0**21, 1.0])]
    want = {}
    x = usable(rows)
    for i, v in x:
        want[i] = sum((3 * a - sum(r[1][j] for r in x)) ** 2 for j, a in enumerate(v))
    assert {r.vec_id: r.deviation for r in run(spark, rows)} == want


def test_empty_alone_and_other_lengths(spark):
    assert run(spark, [], 1) == [] and run(spark, [(1, [0.5, 1.0])], 1) == [] and run(spark, [(1, [0.5]), (2, [0.5])], 1) == []
    rows = vectors(20, 4, 3) + [(100 + i, v) for i, v in vectors(5, 6, 4)]
    check(rows, run(spark, rows), size=4)
