"""Whitening against numpy's symmetric eigensolver and exact integers; planted spectra and edge cases."""

import math

import numpy as np
import pytest

from oddsmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, most):
    """Results by key of (key, vector) rows in plain Python and numpy."""
    sound = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in sound})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[(n * x[j] - total[j]) / n for j in range(d)] for x in fit])
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:most], w[:, ::-1][:, :most]
    out = {}
    for key, x in sound:
        out[key] = (n, sum((n * x[j] - total[j]) ** 2 for j in range(d)), (np.array([(n * x[j] - total[j]) / n for j in range(d)]) @ w) / np.sqrt(e), e / np.trace(v))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((6, 6)) * np.array([3, 2, 1.5, 1, 0.5, 0.25])
    rows = [(k, [float(c) for c in mix @ rng.standard_normal(6)]) for k in range(300)]
    rows += [(1000 + k, rows[k % 7][1]) for k in range(150)]  # repeated vectors count once
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, rows[3][1])]
    want = brute(rows, 4)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in whitening.listed(frame, most=4).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    for key, (n, deviation, z, share) in want.items():
        own = got[key]
        assert sorted(own) == [1, 2, 3, 4]
        assert {r.n for r in own.values()} == {n} and {r.deviation for r in own.values()} == {deviation}
        assert [abs(own[k + 1].whitened) for k in range(4)] == pytest.approx(np.abs(z), rel=1e-9, abs=1e-9)
        assert [own[k + 1].explained for k in range(4)] == pytest.approx(share, rel=1e-9)
        assert own[1].identity_error < 1e-9
    signs = {k: {np.sign(got[i][k].whitened * want[i][2][k - 1]) for i in want if abs(want[i][2][k - 1]) > 1e-6} for k in (1, 2, 3, 4)}
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [1, 1, 1, 1], [7, 7, 7, 1, 1], [1, 2, 3], [1e9, 1, 1e-6], [4, 0, 0, 0], [2] + [1] * 30, list(range(1, 65))])
def test_components_of_planted_spectra(spectrum):
    q = np.linalg.qr(np.random.default_rng(len(spectrum)).standard_normal((len(spectrum),) * 2))[0]
    for basis in (q, np.eye(len(spectrum))):
        a = basis @ np.diag(np.array(spectrum, float)) @ basis.T
        e, w = whitening.components(a, len(spectrum))
        assert e == pytest.approx(sorted(spectrum, reverse=True), abs=1e-13 * max(spectrum))
        assert w.T @ w == pytest.approx(np.eye(len(spectrum)), abs=1e-13)
        assert a @ w == pytest.approx(w * e, abs=1e-13 * max(spectrum))


def test_first_components_only():
    a = np.diag(np.arange(1.0, 41))
    e, w = whitening.components(a, 3)
    assert e == pytest.approx([40, 39, 38]) and w.shape == (40, 3)


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((8, 8))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert whitening.halley_polar(a) == pytest.approx(v @ np.diag(np.sign(e)) @ v.T, abs=1e-13)


def test_no_variance_and_empty(spark):
    assert whitening.listed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.listed(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    assert whitening.listed(spark.createDataFrame([(1, []), (2, [])], SCHEMA)).collect() == []
    assert whitening.listed(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []


def test_lengths_clashing_columns_and_large_entries(spark):
    rows = [(k, [float(k % 5), float(k % 3)], 1, 2, 3) for k in range(30)] + [(100, [1.0], 1, 2, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, x int, whitened int")
    got = whitening.listed(frame).collect()
    assert {r.vec_id for r in got} == set(range(30)) and {r.n for r in got} == {15}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    out = whitening.listed(huge).collect()
    assert {r.vec_id for r in out} == {1, 2, 3} and {r.deviation for r in out if r.vec_id == 1} == {None}
