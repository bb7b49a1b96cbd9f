"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from wardwatch.llm import whitening

VECTORS = "vec_id long, embedding array<float>, x string, n long, component long"


def made(spark, rows):
    return spark.createDataFrame([(i, v, "clash", -1, -1) for i, v in rows], VECTORS).repartition(3)


def plain(rows, count=4):
    """``{row number: (n, deviation, |whitened|s, explained)}``, by numpy and whole numbers."""
    good = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, (_, v) in enumerate(rows)
            if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v)]
    out = {}
    for size in {len(x) for _, x in good}:
        fit = [list(x) for x in {tuple(x) for _, x in good if len(x) == size}]
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array(fit, dtype=float) - np.array([s / n for s in sums])
        values, axes = np.linalg.eigh(centred.T @ centred / n)
        values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
        trace = (centred**2).sum() / n
        for k, x in good:
            if len(x) == size:
                scores = (np.array(x, dtype=float) - np.array([s / n for s in sums])) @ axes
                deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
                out[k] = n, deviation, np.abs(scores) / np.sqrt(np.maximum(values, 1e-300)), values, trace
    return out


def compare(spark, rows):
    """With ids that are row numbers; returns the rows found."""
    found = whitening.whitened(made(spark, rows)).collect()
    want = plain(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    for k, (n, deviation, scores, values, trace) in want.items():
        some = sorted(by_id.pop(rows[k][0]), key=lambda r: r["component"])
        assert [r["component"] for r in some] == list(range(1, len(values) + 1))
        for r, score, value in zip(some, scores, values):
            assert r["n"] == n and r["deviation"] == deviation
            if value > 1e-9 * trace:
                assert abs(r["whitened"]) == pytest.approx(score, abs=1e-7)
                assert r["explained"] == pytest.approx(value / trace, rel=1e-9) and r["identity_error"] < 1e-9
            else:
                assert r["whitened"] is None
    assert not by_id
    return found


def test_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(0.2, 3, 12) @ rng.normal(size=(12, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[5].tolist()) for i in range(200)]  # a hot copy counts once in the fit
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [1.0] * 11 + [float("inf")]), (2004, [])]
    rows += [(3000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))]  # another length: a fit of its own, three components
    found = compare(spark, rows)
    assert len(found) == 500 * 4 + 40 * 3


def test_signs_agree_between_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 6)) * [9, 7, 5, 3, 2, 1])]
    found = whitening.whitened(made(spark, rows)).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(found.T, bias=True) - np.eye(4)).max() < 1e-9


def test_odd_tables(spark):
    assert whitening.whitened(made(spark, [])).count() == 0
    assert whitening.whitened(made(spark, [(1, None)])).count() == 0
    alone = whitening.whitened(made(spark, [(None, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()  # one distinct vector: no variance
    assert len(alone) == 4
    assert all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in alone)
    flat = compare(spark, [(0, [1.0, 0.5, 0.0]), (1, [2.0, 0.5, 0.0]), (2, [4.0, 0.5, 0.0])])  # one component has all the variance
    assert sorted(r["component"] for r in flat if r["whitened"] is not None) == [1, 1, 1]


def test_large_entries_are_exact_or_null(spark):
    rows = [(i, [float(v), 1.0]) for i, v in enumerate([2**20, 3 * 2**20, -(2**20)])]
    compare(spark, rows)
    huge = whitening.whitened(made(spark, [(0, [1e30, 0.0]), (1, [-1e30, 0.0]), (2, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge if r["vec_id"] != 2} == {None}


@pytest.mark.parametrize("values", [
    [5, 5, 5, 5], [9, 4, 4, 1], [3, 2, 1, 0], [1e12, 1, 1e-3, 1e-9], [1, -1, 1, -1], [2, 1 + 1e-13, 1, 0], list(range(40)), [1.5**-i for i in range(40)],
])
def test_components_of_known_spectra(values):
    rng = np.random.default_rng(len(values))
    turn = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    matrix = turn * np.array(values, dtype=float) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found = whitening.components_of(matrix, len(values))
    assert found.values == pytest.approx(sorted(values, reverse=True), abs=1e-13 * max(map(abs, values)) * len(values))
    scale = np.linalg.norm(matrix)
    assert np.abs(found.axes.T @ found.axes - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(matrix @ found.axes - found.axes * found.values) < 1e-12 * scale


def test_polar_factor():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    u, _, v = np.linalg.svd(a)
    assert np.abs(whitening.polar(a) - u @ v).max() < 1e-11
