"""The ring background of a whole image, cut into cells, against the same fit pixel by pixel."""

import numpy as np
import pytest

from somaflow.functions import extraction as fx
from somaflow.operators import ring

H, W, T = 21, 26, 90


def frames_of(spark, movie):
    return spark.createDataFrame([(t, f.ravel().tolist()) for t, f in enumerate(movie)], "t long, px array<double>").repartition(3)


@pytest.mark.parametrize("cell, radius", [(8, 3), (32, 2), (5, 4)])
def test_cells_have_no_borders(spark, monkeypatch, cell, radius):
    monkeypatch.setattr(ring, "CELL", cell)
    monkeypatch.setattr(ring, "VALUES", 20_000)
    rng = np.random.default_rng(cell)
    movie = rng.standard_normal((T, H * W)) + rng.random((T, 2)) @ rng.random((2, H * W)) * 5 + 3
    near, weights = fx.ring_weights(movie - movie.mean(axis=0), (H, W), radius)
    got = {r["p"]: (r["near"], r["weights"]) for r in ring.ring_weights(frames_of(spark, movie), H, W, radius).collect()}
    assert sorted(got) == list(range(H * W))
    for p, (n, v) in got.items():
        assert n == near[p][near[p] >= 0].tolist() and np.allclose(v, weights[p][near[p] >= 0], atol=1e-7)


def test_background_without_neurons(spark, monkeypatch):
    monkeypatch.setattr(ring, "CELL", 10)
    rng = np.random.default_rng(2)
    a = np.zeros((2, H * W))
    a[0, [30, 31, 56, 57]], a[1, [9 * W + 9, 9 * W + 10, 10 * W + 9, 10 * W + 10]] = 1.0, 2.0  # one where four cells meet
    c = rng.random((T, 2))
    movie = rng.random((T, 3)) @ rng.random((3, H * W)) + c @ a + 0.01 * rng.standard_normal((T, H * W))
    rows = [(k, np.flatnonzero(a[k]).tolist(), a[k][a[k] > 0].tolist(), c[:, k].tolist()) for k in range(2)]
    neurons = spark.createDataFrame(rows, "k long, px array<int>, a array<double>, c array<double>")
    got = {r["t"]: r["px"] for r in ring.ring_background(frames_of(spark, movie), H, W, 3, neurons).collect()}
    assert np.allclose([got[t] for t in range(T)], fx.ring_background(movie, a, c, (H, W), 3), atol=1e-6)


def test_flat_and_no_movies(spark):
    flat = {r["t"]: r["px"] for r in ring.ring_background(frames_of(spark, np.full((5, H * W), 7.0)), H, W, 2).collect()}
    assert np.allclose([flat[t] for t in range(5)], 7.0)
    assert ring.ring_weights(spark.createDataFrame([], "t long, px array<double>"), H, W, 2).count() == 0
