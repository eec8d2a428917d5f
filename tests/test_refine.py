"""The update of all components over cells, and the graph steps under it, against the same steps on whole matrices."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from somaflow.functions import extraction as fx
from somaflow.operators import extraction, graph, refine
from somaflow.params import ExtractionParams, MergeParams, SpatialParams, TemporalParams

H, W, T = 37, 45, 160


def scene(seed, n=9):
    """Cells that overlap, some across borders of the grid, over a background; noisy first guesses of their shapes and traces."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:H, :W]
    centers = np.column_stack((rng.uniform(2, H - 3, n), rng.uniform(2, W - 3, n)))
    centers[:4] = [[31, 31], [33, 34], [10, 31], [31, 12]]
    a = np.array([np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 6) for cy, cx in centers])
    a[a < 0.15] = 0
    s = (rng.random((T, n)) < 0.05) * rng.random((T, n)) * 4
    c = s.copy()
    for t in range(1, T):
        c[t] += 0.85 * c[t - 1]
    b, f = rng.random((2, H * W)), rng.random((2, T))
    a = a.reshape(n, -1)
    movie = c @ a + f.T @ b + 0.1 * rng.standard_normal((T, H * W))
    return movie.astype(np.float32), a * (1 + 0.1 * rng.random(a.shape)), np.maximum(c + 0.2 * rng.standard_normal(c.shape), 0), b, f


def tables(spark, movie, a, c, ids, b, f):
    frames = spark.createDataFrame([(t, m.tolist()) for t, m in enumerate(movie)], "t long, px array<float>").repartition(4)
    rows = [(k, 0, np.flatnonzero(v).tolist(), v[v > 0].tolist(), *[c[:, i].tolist()] * 3) for i, (k, v) in enumerate(zip(ids, a))]
    back = spark.createDataFrame([(i, v.tolist(), g.tolist()) for i, (v, g) in enumerate(zip(b, f))], "component int, b array<double>, f array<double>")
    return frames, spark.createDataFrame(rows, f"k long, {extraction.COMPONENT}").repartition(3), back


def matrices(df, ids):
    found = {r["k"]: r for r in df.collect()}
    a = np.zeros((len(ids), H * W))
    for i, k in enumerate(ids):
        a[i, found[k]["px"]] = found[k]["a"]
    return a, np.array([found[k]["c"] for k in ids]).T, np.array([found[k]["s"] for k in ids]).T, np.array([found[k]["yra"] for k in ids]).T


@pytest.mark.parametrize("p", [1, 2])
def test_traces_equal_the_sweep_over_the_whole_image(spark, save, p):
    movie, a, c, b, f = scene(1)
    ids = [(3 * i - 7) * 1_000_000_000_000_007 for i in range(len(a))]
    frames, components, _ = tables(spark, movie, a, c, ids, b, f)
    params = ExtractionParams(temporal_params=TemporalParams(p=p))
    movies = save(refine.cell_movies(frames, H, W), "cells")
    got = matrices(refine.update_traces(movies, components, (b, f), H, W, params, save, "traces"), ids)
    y = movie.astype(float) - f.T @ b
    want_a, want_c, want_s = fx.update_temporal(y, a, c, params.temporal_params)
    assert np.allclose(got[0], want_a) and np.allclose(got[1], want_c, atol=1e-6) and np.allclose(got[2], want_s, atol=1e-6)
    assert np.allclose(got[3], fx.residual_traces(y, want_a, want_c), atol=1e-6)


@pytest.mark.parametrize("normalize", [True, False])
def test_footprints_equal_the_regression_over_the_whole_image(spark, save, normalize):
    movie, a, c, b, f = scene(2)
    ids = list(range(len(a)))
    frames, components, _ = tables(spark, movie, a, c, ids, b, f)
    params = ExtractionParams(spatial_params=SpatialParams(normalize=normalize))
    movies = save(refine.cell_movies(frames, H, W), "cells")
    got = matrices(refine.update_footprints(movies, components, (b, f), H, W, params, save, "shapes"), ids)[0]
    y = movie.astype(float) - f.T @ b
    want, _ = fx.update_spatial(y, a, c, fx.spectrum_noise(y.T, "mean"), (H, W), params.spatial_params)
    assert len(want) == len(ids) and np.allclose(got, want, atol=1e-6)


def test_every_component_is_kept_with_its_id(spark, save):
    """Two components whose shapes were exchanged, so that each comes nearest to the other's old one, are both kept."""
    movie, a, c, b, f = scene(3)
    wide = a.copy()
    wide[[0, 1]] = wide[[0, 1]] + 0.9 * wide[[1, 0]]  # both cover both cells; only the traces tell which is which
    ids = [100 + i for i in range(len(a))]
    frames, components, back = tables(spark, movie, wide, c, ids, b, f)
    out = refine.evaluate(frames, components, back, H, W, ExtractionParams(), save)
    found = {r["k"]: r for r in out.collect()}
    assert sorted(found) == ids and all(np.isclose(np.linalg.norm(r["a"]), 1) for r in found.values())
    for i, k in enumerate(ids):
        assert np.corrcoef(found[k]["c"], c[:, i])[0, 1] > 0.8


def test_empty_components_go_and_nothing_gives_nothing(spark, save):
    movie, a, c, b, f = scene(4, 5)
    frames, components, back = tables(spark, movie, np.concatenate((a, np.zeros((1, H * W)))), np.column_stack((c, c[:, 0])), range(6), b, f)
    assert sorted(r["k"] for r in refine.evaluate(frames, components, back, H, W, ExtractionParams(), save).collect()) == list(range(5))
    assert refine.evaluate(frames, components.limit(0), back, H, W, ExtractionParams(), save).count() == 0


def test_colours_are_those_of_going_through_in_order(spark, save):
    rng = np.random.default_rng(5)
    n = 120
    links = {(min(i, j), max(i, j)) for i, j in rng.integers(0, n, (400, 2)).tolist() if i != j}
    want = {}
    for k in range(n):
        taken = {want[i] for i in range(k) if (i, k) in links}
        want[k] = next(c for c in range(n) if c not in taken)
    nodes = spark.range(n).withColumnRenamed("id", "k")
    edges = spark.createDataFrame([(j, i) if rng.random() < 0.5 else (i, j) for i, j in links], "i long, j long")
    assert {r["k"]: r["colour"] for r in graph.coloured(nodes, edges, save).collect()} == want


def test_long_paths_connect_in_few_rounds(spark, save):
    rounds = []

    def counted(df, name):
        rounds.append(name)
        return save(df, name)

    order = np.random.default_rng(6).permutation(500).tolist()
    edges = [(order[i], order[i + 1]) for i in range(499)] + [(1000, 1001), (1001, 1002), (7, 7)]
    for path in (edges, [(i, i + 1) for i in range(499)]):
        rounds.clear()
        got = {r["k"]: r["root"] for r in graph.connected(spark.createDataFrame(path, "i long, j long"), counted).collect()}
        assert all(got[k] == 0 for k in range(500)) and got.get(1002, 1000) == 1000 and len(rounds) < 15
    assert graph.connected(spark.createDataFrame([], "i long, j long"), save).count() == 0


def test_groups_go_by_summed_correlation(spark, save):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((3, 80))
    c = [base[0], base[0] + 0.3 * rng.standard_normal(80), base[1], base[1] + 0.1 * rng.standard_normal(80), base[1] + 0.1 * rng.standard_normal(80), base[2], np.zeros(80)]
    px = [[0, 1], [1, 2], [10, 11], [11, 12], [12, 13, 11], [1, 11], [0, 1]]
    rows = [(k, 0, p, [1.0] * len(p), *[v.tolist()] * 3) for k, (p, v) in enumerate(zip(px, c))]
    df = spark.createDataFrame(rows, f"k long, {extraction.COMPONENT}")
    params = ExtractionParams(merge_params=MergeParams(thr=0.8, compat=False))
    groups, order = extraction.merge_plan(df, params, save)
    assert sorted(map(tuple, groups.collect())) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)]
    r = lambda i, j: np.corrcoef(c[i], c[j])[0, 1]
    got = [(x["root"], x["place"]) for x in order.orderBy("place").collect()]
    assert got == [(2, 1), (0, 2)]
    totals = {x["root"]: x["total"] for x in order.collect()}
    assert np.isclose(totals[0], r(0, 1)) and np.isclose(totals[2], r(2, 3) + r(2, 4) + r(3, 4))


def test_a_norm_is_not_computed_for_each_element(spark):
    from somaflow.operators import refine

    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda x: x.cast("double")).alias("c"))
    start = time.perf_counter()
    got = long.select(refine.bound_once(refine._norm("c"), lambda n: F.transform("c", lambda x: x / n)).alias("c")).first()["c"]
    assert time.perf_counter() - start < 20 and np.isclose(np.linalg.norm(got), 1)
