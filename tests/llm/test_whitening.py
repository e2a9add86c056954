"""Whitening against a dense eigendecomposition, and its exact sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hushscan.llm import whitening
from hushscan.llm.whitening import Filter

SCHEMA = "vec_id bigint, embedding array<float>, component string, n int"


def spread(rows, dim, seed=1):
    draw = np.random.default_rng(seed)
    turn = np.linalg.qr(draw.standard_normal((dim, dim)))[0]
    return (draw.standard_normal((rows, dim)) * np.linspace(1, 0.3, dim) ** 2) @ turn


def dense(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    apart = x * n - sums
    centred = apart.astype(float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return (apart * apart).sum(axis=1), centred, values[::-1], basis[:, ::-1]


def held_against(rows, vectors, ids, wanted=8, close=1e-8):
    deviation, centred, values, basis = dense(vectors)
    assert len(rows) == len(ids) * min(wanted, len(values))
    by = {}
    for r in rows:
        by.setdefault(r.component, {})[r.vec_id] = r
    for k in range(min(wanted, len(values))):
        got = np.array([by[k + 1][i].whitened for i in ids])
        want = centred @ basis[:, k] / math.sqrt(values[k])
        sign = np.sign(got @ want)
        assert np.abs(sign * got - want).max() < close
        for i, d in zip(ids, deviation):
            row = by[k + 1][i]
            assert int(row.deviation) == d and row.n == len(ids)
            assert row.explained == pytest.approx(values[k] / values.sum(), rel=1e-10)
            assert 0 <= row.identity_error < 1e-10


def test_against_dense(spark):
    vectors = np.float32(spread(700, 64))
    bad = [(9000, None, "a", 1), (9001, [None] + [1.0] * 63, "a", 1), (9002, [float("nan")] * 64, "a", 1), (9003, [float("inf")] * 64, "", 1), (9004, [], "", 1), (9005, [1e30] * 64, "", 1)]
    rows = [(i, v.tolist(), "x", 3) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    out = whitening.whitened_components(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held_against(out.collect(), vectors.tolist(), list(range(700)))


def test_filter_is_used_and_certified(spark):
    vectors = np.float32(spread(400, 96, seed=5))
    df = spark.createDataFrame([(i, v.tolist(), "", 0) for i, v in enumerate(vectors)], SCHEMA)
    table = whitening.prepared(df).cache()
    model = whitening.fit(table, 96, Filter(guard=8))
    assert model.passes > 20  # the block of 16 has to be filtered
    assert model.residuals.max() <= 1e-12 * model.values[0]
    _, _, values, _ = dense(vectors.tolist())
    assert np.abs(model.values / values[:8] - 1).max() < 1e-12
    table.unpersist()


def test_steep_spectrum(spark):
    """Variances over eight orders of magnitude: the smaller ones must not drown in the larger."""
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((300, 60)) * 10.0 ** np.linspace(4, 0, 60)
    df = spark.createDataFrame([(i, v.tolist(), "", 0) for i, v in enumerate(vectors)], SCHEMA.replace("float", "double"))
    held_against(whitening.whitened_components(df).collect(), vectors.tolist(), list(range(300)), close=1e-7)


def test_few_dimensions_ties_and_copies(spark):
    vectors = [[1.0, 0.0, 2.0], [0.0, 1.0, 2.0], [-1.0, 0.0, 2.0], [0.0, -1.0, 2.0], [0.5, 0.5, 2.0]] * 3
    df = spark.createDataFrame([(i % 7, v, "", 0) for i, v in enumerate(vectors)], SCHEMA)
    rows = whitening.whitened_components(df).collect()
    assert len(rows) == 15 * 3 and {r.component for r in rows} == {1, 2, 3}
    # the third axis does not vary
    assert all((r.whitened is None) == (r.component == 3) for r in rows)
    assert all(r.identity_error < 1e-12 for r in rows)
    assert sum({r.component: r.explained for r in rows}.values()) == pytest.approx(1)


def test_nothing_varies_one_row_and_none(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], "", 0) for i in range(4)], SCHEMA)
    rows = whitening.whitened_components(same).collect()
    assert len(rows) == 8 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in rows)
    assert whitening.whitened_components(same.where("vec_id = 0")).count() == 2
    assert whitening.whitened_components(same.where("vec_id < 0")).count() == 0


def test_lengths_are_fitted_apart(spark):
    rows = [(i, [float(i), float(i * i)], "", 0) for i in range(6)] + [(None, [float(i)], "", 0) for i in range(3)]
    got = whitening.whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.n, r.component) for r in got) == sorted([(6, 1)] * 6 + [(6, 2)] * 6 + [(3, 1)] * 3)


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**40, -(2.0**40) + 1], [2.0**41, 3.5], [-5.25, 2.0**39]]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in enumerate(vectors)], SCHEMA.replace("float", "double"))
    deviation, *_ = dense(vectors)
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened_components(df).collect()}
    assert got == dict(enumerate(deviation))
