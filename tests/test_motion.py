"""Motion correction by runs of blocks: the same results as frame by frame, in few jobs."""

import numpy as np
import pytest

from somaflow.functions import registration, simulate
from somaflow.operators import motion

PARAMS = motion.MotionParams(strides=(10, 9), overlaps=(4, 4), max_deviation_rigid=2, max_shifts=(2, 2), nb_round=2, filter_size=3, filter_size_patch=2, block_size=6, template_frames=8)


def one_by_one(movie: dict[int, np.ndarray], params: motion.MotionParams) -> dict[int, np.ndarray]:
    """The loop over rounds, blocks and frames."""
    now = dict(movie)
    template = np.nanmedian([f for t, f in now.items() if t < params.template_frames], axis=0)
    for _ in range(params.nb_round):
        for start in range(0, max(now) + 1, params.block_size):
            block = [t for t in now if start <= t < start + params.block_size]
            target = registration.Target(template, params)
            for t in block:
                now[t] = registration.correct_frame(now[t], target)
            if block:
                template = np.nanmedian([now[t] for t in block], axis=0)
    return now


@pytest.mark.parametrize("run_values, saves", [(0, 12), (5 * 6 * 20 * 18, 4), (10**9, 2)])
def test_runs_follow_the_template_from_block_to_block(spark, save, run_values, saves, tmp_path):
    shifts = np.random.default_rng(4).integers(-2, 3, (46, 2)).astype(float)
    drifted = simulate.drifting(len(shifts), (20, 18), shifts)
    movie = {t: f for t, f in enumerate(drifted) if not 18 <= t < 31}  # two blocks have no frame, one begins late
    rows = [(t, f.ravel().tolist()) for t, f in movie.items()]
    frames = spark.createDataFrame(rows[::-1], "t long, px array<double>").repartition(5)
    names = []
    out = motion.motion_correct(frames, 20, 18, PARAMS, lambda df, name: (names.append(name), save(df, name))[1], run_values, f"file://{tmp_path}/runs")
    got = {r["t"]: np.array(r["px"]).reshape(20, 18) for r in out.collect()}
    right = one_by_one(movie, PARAMS)
    assert len(names) == saves and sorted(got) == sorted(right)
    assert max(np.abs(got[t] - right[t]).max() for t in right) < 1e-9


def test_blocks_are_cut_across_arrow_batches(spark, save):
    movie = simulate.drifting(25, (20, 18), np.random.default_rng(5).integers(-1, 2, (25, 2)).astype(float))
    frames = spark.createDataFrame([(t, f.ravel().tolist()) for t, f in enumerate(movie)], "t long, px array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = motion.motion_correct(frames, 20, 18, PARAMS, save, 10**9).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    right = one_by_one(dict(enumerate(movie)), PARAMS)
    assert len(out) == 25 and max(np.abs(np.array(r["px"]).reshape(20, 18) - right[r["t"]]).max() for r in out) < 1e-9


def test_blocks_of_frames_equal_single_frames(monkeypatch):
    rng = np.random.default_rng(6)
    movie = simulate.drifting(30, (20, 18), rng.normal(0, 1.5, (30, 2)))
    movie[3] = 0
    for grid in (1, 2):
        params = motion.MotionParams(**(PARAMS.__dict__ | {"upsample_factor_grid": grid}))
        target = registration.Target(np.median(movie, axis=0), params)
        alone = np.stack([registration.correct_frame(f, target) for f in movie])
        calls = []
        inner = registration.piecewise_corrected
        monkeypatch.setattr(registration, "piecewise_corrected", lambda *a: (calls.append(1), inner(*a))[1])
        assert np.allclose(registration.correct_block(movie, target), alone, atol=1e-9) and len(calls) == 1
        monkeypatch.setattr(registration, "piecewise_corrected", inner)
        monkeypatch.setattr(registration, "TOGETHER", 7 * 360)
        assert np.allclose(registration.correct_block(movie, target), alone, atol=1e-9)
        monkeypatch.undo()
