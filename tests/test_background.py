"""The compressed background by strips and chunks, against the same steps on whole matrices."""

import numpy as np
import pytest

from somaflow.functions import extraction as fx
from somaflow.operators import background, geometry


def parts_of(h, w, frames, each, seed):
    rng, rows = np.random.default_rng(seed), []
    for n, y0, y1, x0, x1 in geometry.analysis_patches(h, w, (2, 3), 6):
        px = (np.arange(y0, y1)[:, None] * w + np.arange(x0, x1)).ravel()
        rows += [(n, rng.permutation(px).tolist(), rng.normal(0.3, 1, len(px)).tolist(), (rng.random(frames) + np.sin(np.arange(frames) / 9 + k)).tolist()) for k in range(each)]
    return rows


SCHEMA = "patch int, px array<int>, b array<double>, f array<double>"


@pytest.mark.parametrize("rank", [1, 4, 50])
def test_strips_and_chunks_give_the_whole_solution(spark, monkeypatch, rank):
    h, w, frames = 20, 31, 150
    rows = parts_of(h, w, frames, 2, rank)
    monkeypatch.setattr(background, "STRIP", 70)
    monkeypatch.setattr(background, "CHUNK_VALUES", len(rows) * 23)
    got, losses = background.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5), h * w, rank, seed=3)
    found = {r["component"]: (np.array(r["b"]), np.array(r["f"])) for r in got.collect()}
    b, cover = np.zeros((len(rows), h * w)), np.zeros(h * w)
    for r in rows[::2]:
        cover[r[1]] += 1
    for i, r in enumerate(rows):
        b[i, r[1]] = np.array(r[2]) / cover[r[1]]
    f = np.stack([np.array(r[3]) for r in rows], axis=1)
    s, g = fx.compressed_background(b, f, rank, 3)
    # rank 50 exceeds the parts: as many as those, some of them nearly dependent
    assert len(found) == len(s) == min(rank, len(rows))
    if rank < len(rows):
        assert all(np.abs(found[k][0] - s[k]).max() < 1e-6 and np.abs(found[k][1] - g[:, k]).max() < 1e-6 * max(1, np.abs(g).max()) for k in found)
    model = sum(np.outer(v[1], v[0]) for v in found.values())
    whole = (f @ b) ** 2
    assert np.isclose(losses[-1], ((f @ b - model) ** 2).sum() - whole.sum(), rtol=1e-6)


def test_the_residual_does_not_rise(spark):
    rows = [(p, px, np.abs(b).tolist(), f) for p, px, b, f in parts_of(12, 12, 60, 2, 9)]
    for rank in (1, 3):
        _, losses = background.compressed(spark.createDataFrame(rows, SCHEMA), 144, rank)
        assert all(b <= a + 1e-9 * abs(a) for a, b in zip(losses, losses[1:]))


def test_pixels_outside_all_patches_and_no_parts(spark):
    got, _ = background.compressed(spark.createDataFrame([(0, [5], [2.0], [1.0, 3.0])], SCHEMA), 20_000, 1)
    (r,) = got.collect()
    assert len(r["b"]) == 20_000 and np.flatnonzero(r["b"]).tolist() == [5] and np.allclose(np.array(r["f"]) * r["b"][5], [2, 6])
    none, losses = background.compressed(spark.createDataFrame([], SCHEMA), 10, 2)
    assert none.count() == 0 and losses == []
    with pytest.raises(ValueError):
        background.compressed(spark.createDataFrame([(0, [1], [1.0], [1.0]), (0, [1], [1.0], [1.0, 2.0])], SCHEMA), 4, 1)
