"""The store of versions: whole or not at all, also where tasks fail; and statistics of movies longer than a task's memory."""

import numpy as np
import pytest

from somaflow.functions import simulate
from somaflow.operators import layout, motion, stats
from somaflow.sources import versions


def test_versions_are_replaced_and_dropped_as_a_whole(spark, tmp_path):
    store = f"file://{tmp_path}/movie"
    df = spark.range(100).selectExpr("id AS t", "array(id * 1.5, NULL) AS px").repartition(4)
    versions.write_version(df, store, "round-0")
    versions.write_version(df.where("t < 10"), store, "round-1")
    assert versions.versions(store) == {"round-0": 100, "round-1": 10}
    assert sorted(map(tuple, versions.read_version(spark, store, "round-0").collect())) == sorted(map(tuple, df.collect()))
    assert versions.read_version(spark, store, "round-0").dtypes == df.dtypes
    versions.write_version(df.where("t >= 95"), store, "round-0")
    assert sorted(r["t"] for r in versions.read_version(spark, store, "round-0").collect()) == list(range(95, 100))
    versions.write_version(df.limit(0), store, "empty")
    assert versions.read_version(spark, store, "empty").count() == 0
    versions.drop_version(store, "round-0")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, store, "round-0")
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "movie/data").iterdir()}
    assert left == {"round-1"} and not [p for p in (tmp_path / "movie").rglob("*.part")]
    for name in ("", "a/b", ".x"):
        with pytest.raises(ValueError):
            versions.write_version(df, store, name)


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    store = f"file://{tmp_path}/movie"
    df = spark.range(40, numPartitions=4).selectExpr("id AS t", "array(double(id)) AS px")
    versions.write_version(df, store, "good")

    def fail(batches):
        for batch in batches:
            yield batch
            if 39 in batch.column(0).to_pylist():
                raise RuntimeError("this task fails after it has written rows")

    for name in ("good", "new"):
        with pytest.raises(Exception, match="this task fails"):
            versions.write_version(df.mapInArrow(fail, df.schema), store, name)
    assert versions.versions(store) == {"good": 40}
    assert sorted(r["t"] for r in versions.read_version(spark, store, "good").collect()) == list(range(40))
    versions.sweep(store)
    assert len(list((tmp_path / "movie/data").glob("good-*"))) >= 1
    __import__("time").sleep(1)  # a task that was still running may have left a folder
    versions.sweep(store, 0)
    assert len(list((tmp_path / "movie/data").glob("good-*"))) == 1
    assert not list((tmp_path / "movie").rglob("*.part")) and not list((tmp_path / "movie/data").glob("new-*"))


def test_an_attempt_that_fails_is_made_again_once(spark, tmp_path):
    """Two attempts of one task: only the file of the one that is reported counts."""
    import pyarrow as pa

    store = f"file://{tmp_path}/movie"
    writer = versions._Writer(store, "v", spark.range(1).schema)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["id"])

    def broken():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([again, writer.write(iter([]))])
    assert versions.versions(store) == {"v": 2} and first.file != again.file
    assert versions.read_version(spark, store, "v").count() == 2


def test_motion_rounds_as_versions(spark, tmp_path):
    movie = simulate.drifting(12, (20, 18), np.zeros((12, 2)))
    frames = spark.createDataFrame([(t, f.ravel().tolist()) for t, f in enumerate(movie)], "t long, px array<double>")
    params = motion.MotionParams(strides=(10, 9), overlaps=(4, 4), max_deviation_rigid=2, max_shifts=(2, 2), nb_round=2, filter_size=3, filter_size_patch=2, block_size=6, template_frames=6)
    out = motion.motion_correct(frames, 20, 18, params, versions.version_save(spark, f"file://{tmp_path}/motion"))
    assert out.count() == 12 and versions.versions(f"file://{tmp_path}/motion") == {f"motion-{r}-{s}": 6 for r in (0, 1) for s in (0, 6)}


def test_long_movies_are_held_in_narrow_strips(spark, monkeypatch):
    monkeypatch.setattr(layout, "STRIP_VALUES", 4000)
    rng = np.random.default_rng(3)
    m = rng.standard_normal((900, 30))
    frames = spark.createDataFrame([(t, f.tolist()) for t, f in enumerate(m)], "t long, px array<double>").repartition(7)
    assert layout.strip_width(900) == 4 and layout.strip_width(10**9) == 1 and layout.strip_width(0) == layout.STRIP
    held = layout.by_strips(frames, lambda x: np.full(x.shape[1], x.size), "p int, size double").agg(F.max("size")).first()[0]
    assert held <= 4000
    assert np.allclose([r["template"] for r in stats.template(frames).orderBy("p").collect()], np.median(m, axis=0))
    for method in ("mean", "median", "logmexp"):
        assert np.allclose([r["sn"] for r in stats.noise_image(frames, method, None).orderBy("p").collect()], stats.spectrum_noise(m.T, method))
