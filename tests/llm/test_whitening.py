"""Whitening against numpy in exact whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tracewell.llm import whitening

SCHEMA = "label int, vec_id long, embedding array<float>, n long, component string"


def table(spark, vectors, ids=None, parts=3):
    rows = [(0, i, v, 7, "x") for i, v in zip(range(len(vectors)) if ids is None else ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def drawn(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(c)) for c in v] for v in (rng.normal(size=(n, d)) * rng.uniform(0.05, 2, d) + rng.normal(size=d) * 9)]


def steps(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def held_to_numpy(rows, vectors, components):
    x = np.array([steps(v) for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    centred = (x * n - total).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(rows) == n * min(components, x.shape[1])
    for r in rows:
        i, k = r["vec_id"], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], total, strict=True))
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(centred[i] @ axes[:, k] / math.sqrt(values[k])), abs=1e-7)
        assert 0 <= r["identity_error"] < 1e-8
    for k in range(1, min(components, x.shape[1]) + 1):
        told = np.array([r["whitened"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["component"] == k])
        mine = centred @ axes[:, k - 1]
        assert abs(told @ mine) == pytest.approx(np.linalg.norm(told) * np.linalg.norm(mine))


@pytest.mark.parametrize(("n", "d", "components"), [(300, 5, 32), (200, 40, 32), (60, 6, 2)])
def test_whitening_is_numpy(spark, n, d, components):
    vectors = drawn(n, d)
    held_to_numpy(whitening.components_of(table(spark, vectors), components=components).collect(), vectors, components)


def test_a_third_of_equal_vectors_and_a_far_mean(spark):
    vectors = drawn(200, 4)
    vectors = [[c + 1e5 for c in v] for v in vectors + [vectors[0]] * 100]
    vectors = [[float(np.float32(c)) for c in v] for v in vectors]
    held_to_numpy(whitening.components_of(table(spark, vectors, parts=7)).collect(), vectors, 32)


def test_unusable_vectors_go(spark):
    good = drawn(50, 3)
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [0.0, float("inf"), 0.0], [3e38, 0.0, 0.0], [1.0, 2.0]]
    rows = whitening.components_of(table(spark, good + bad)).collect()
    assert {r["vec_id"] for r in rows} == set(range(50))
    held_to_numpy(rows, good, 32)


def test_no_variance_empty_and_null_ids(spark):
    assert whitening.components_of(table(spark, [])).collect() == []
    assert whitening.components_of(table(spark, [None, [float("nan")]])).collect() == []
    out = whitening.components_of(table(spark, [[1.0, 2.0]], [None])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in out] == [(None, 1, 1, 0, None, None, None), (None, 2, 1, 0, None, None, None)]
    flat = whitening.components_of(table(spark, [[0.0, 5.0], [1.0, 5.0], [2.0, 5.0]], [4, 4, 4])).collect()
    assert {r["component"] for r in flat if r["whitened"] is None} == {2} and {r["explained"] for r in flat} == {1.0, 0.0}


def test_deviation_is_exact_or_null(spark):
    big = [[2.0**40, 0.0], [-(2.0**40), 0.5], [0.0, 0.25]]
    assert {r["deviation"] for r in whitening.components_of(table(spark, big)).collect()} == {None, (3 * 16 - 48) ** 2}
    exact = [[2.0**20 + random.Random(i).random(), 0.0] for i in range(3)]
    exact[0][0] += 2.0**18
    exact = [[float(np.float32(c)) for c in v] for v in exact]
    x = [steps(v) for v in exact]
    total = [sum(c) for c in zip(*x, strict=True)]
    out = {r["vec_id"]: r["deviation"] for r in whitening.components_of(table(spark, exact)).collect()}
    assert out == {i: sum((3 * a - s) ** 2 for a, s in zip(v, total, strict=True)) for i, v in enumerate(x)}


def test_merging_is_one_pass():
    x = np.random.default_rng(1).integers(-500, 500, (90, 4))
    whole = whitening._moments(x)
    for cut in (1, 30, 89):
        n, total, mean, scatter = whitening.merged(whitening._moments(x[:cut]), whitening._moments(x[cut:]))
        assert (n, total) == whole[:2] and np.allclose(mean, whole[2]) and np.allclose(scatter, whole[3])
