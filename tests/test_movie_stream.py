"""A folder of videos that grows, as a stream: offsets by file and frame, restarts in the middle."""

import numpy as np

from somaflow.sources import movies


def run(spark, pattern, place, seen):
    def take(df, _):
        for r in df.collect():
            seen.setdefault(r["t"], []).append(r["px"])

    q = movies.stream_movie(spark, pattern).writeStream.option("checkpointLocation", f"file://{place}/ck").foreachBatch(take).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    m = np.random.default_rng(1).integers(0, 255, (700, 5, 6)).astype(np.uint8)
    folder, seen = tmp_path / "in", {}
    folder.mkdir()
    movies.write_avi(f"{folder}/msCam1.avi", m[:300])
    movies.write_avi(f"{tmp_path}/whole2.avi", m[300:650])
    second = (tmp_path / "whole2.avi").read_bytes()
    (folder / "msCam2.avi").write_bytes(second[: len(second) // 2])  # a file that is still being written
    pattern = f"{folder}/msCam*.avi"
    run(spark, pattern, tmp_path, seen)
    half = len(seen)
    assert 300 < half < 650 and sorted(seen) == list(range(half))
    movies.write_avi(f"{folder}/msCam10.avi", m[650:])  # waits for the second to be whole
    run(spark, pattern, tmp_path, seen)
    assert len(seen) == half
    (folder / "msCam2.avi").write_bytes(second)
    run(spark, pattern, tmp_path, seen)
    assert sorted(seen) == list(range(700)) and all(len(v) == 1 for v in seen.values())
    assert (np.array([seen[t][0] for t in range(700)]) == m.reshape(700, -1)).all()
    whole = movies.load_movie(spark, pattern).count()
    assert whole == 700


def test_offsets_are_files_and_frames(tmp_path):
    m = np.zeros((20, 4, 4), np.uint8)
    pattern = f"{tmp_path}/v*.avi"
    reader = movies._AviStream(pattern)
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    movies.write_avi(f"{tmp_path}/v1.avi", m)
    one = reader.latestOffset()
    assert one == {"file": f"{tmp_path}/v1.avi", "frame": 20, "start": 0}
    (tmp_path / "v2.avi").write_bytes(b"")
    assert reader.latestOffset() == {"file": f"{tmp_path}/v2.avi", "frame": 0, "start": 20}
    movies.write_avi(f"{tmp_path}/v2.avi", m[:7])
    two = reader.latestOffset()
    parts = reader.partitions(one, two)
    assert [(p.path, p.first, p.stop, p.start) for p in parts] == [(f"{tmp_path}/v2.avi", 0, 7, 20)]
    # another reader, as after a restart, has the same parts
    assert [(p.path, p.first, p.stop, p.start) for p in movies._AviStream(pattern).partitions({"file": f"{tmp_path}/v1.avi", "frame": 12, "start": 0}, two)] == [(f"{tmp_path}/v2.avi", 0, 7, 20), (f"{tmp_path}/v1.avi", 12, 20, 0)]
