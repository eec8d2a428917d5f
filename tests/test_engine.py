"""The Spark operators: queries against DuckDB, motion, extraction, sources, streaming."""

import duckdb
import numpy as np
import pytest

from somaflow.functions import simulate
from somaflow.operators import extraction, geometry, layout, motion, stats, traces
from somaflow.params import ExtractionParams, InitParams, PatchParams, TemporalParams, default_parameters, load
from somaflow.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(values):
    def cell(v):
        if isinstance(v, float):
            return None if v != v else f"{v:.8g}"
        return None if v is None else str(v)

    return sorted(tuple(map(cell, r)) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = rows([tuple(r[c] for c in names) for r in df.collect()])
    rel = duck.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == names
    want = rows([tuple(r[cols.index(c)] for c in names) for r in rel.fetchall()])
    numeric = lambda x: tuple(map(tuple, x))
    assert numeric(got) == numeric(want)


def test_few_queries_have_no_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"nmf_background", "motion_correct", "patch_fit", "extract", "merge_components"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_kernel_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["noise_fft_mean", "noise_fft_median", "noise_fft_logmexp", "pnr_image", "correlation_info", "seed_mask", "seed_rank", "pixel_threshold"])
def test_noise_of_a_long_movie_equals_sql(spark, save, tmp_path, name):
    rng = np.random.default_rng(6)
    m = (rng.standard_normal((3100, 64)) * np.linspace(0.1, 1, 3100)[:, None] + rng.random(3100)[:, None]).astype(np.float32)
    save(spark.createDataFrame([(t, f.tolist(), t % 10) for t, f in enumerate(m)], "vec_id long, embedding array<float>, label int"), "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    df, rel = catalogue.queries()[name](spark, f"file://{tmp_path}"), con.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    want = rel.fetchall()
    assert want and rows([tuple(r[c] for c in cols) for r in df.collect()]) == rows(want)


def frames(spark, movie):
    return spark.createDataFrame([(t, f.ravel().tolist()) for t, f in enumerate(movie)], "t long, px array<double>").repartition(4)


def test_statistics_ignore_nan_and_flat_pixels(spark):
    m = np.random.default_rng(0).random((30, 4, 4))
    m[:, 1, 1] = 3.0
    cn = {r["p"]: r["cn"] for r in stats.correlation_image(frames(spark, m), 4, 4).collect()}
    assert cn[5] == 0
    m[3, 0, 0] = np.nan
    t = {r["p"]: r["template"] for r in stats.template(frames(spark, m)).collect()}
    assert np.isclose(t[0], np.nanmedian(m[:, 0, 0]))


def test_empty_movie(spark):
    none = spark.createDataFrame([], "t long, px array<double>")
    assert stats.template(none).count() == 0 and stats.correlation_image(none, 4, 4).count() == 0
    assert motion.motion_correct(none, 4, 4, motion.MotionParams(), lambda d, n: d).count() == 0


def test_nearest_center_checks_its_size(spark):
    big = spark.range(5).selectExpr("id AS c", "cast(id AS double) AS at")
    with pytest.raises(ValueError):
        geometry.checked(big, "centres", 3)


def test_outer_checks_its_image(spark, monkeypatch):
    from somaflow.operators import linear

    image, over_time = spark.range(5).selectExpr("id AS p", "2.0D AS b"), spark.range(3).selectExpr("id AS t", "double(id) AS f")
    assert linear.outer(over_time, image).count() == 15
    monkeypatch.setattr(linear, "IMAGE_PIXELS", 4)
    with pytest.raises(ValueError):
        linear.outer(over_time, image)


def test_frame_sample_ranges():
    assert layout.frame_sample(100) == [(0, 100)]
    assert sum(b - a for a, b in layout.frame_sample(10_000)) == 3072


def test_motion_correction(spark, save):
    shifts = np.array([(0, 0)] * 6 + [(2, -1), (-1, 2), (1, 1), (0, 0), (3, 0), (-2, -2)] * 2, float)
    movie = simulate.drifting(len(shifts), (44, 40), shifts)
    params = motion.MotionParams(strides=(22, 20), overlaps=(6, 6), max_deviation_rigid=4, max_shifts=(3, 3), nb_round=1, filter_size=4, filter_size_patch=3, block_size=10, template_frames=6)
    out = motion.motion_correct(frames(spark, movie), 44, 40, params, save)
    got = np.array([r["px"] for r in out.orderBy("t").collect()]).reshape(len(shifts), 44, 40)
    inner = (slice(None), slice(8, -8), slice(8, -8))
    assert np.abs(got - movie[0])[inner].mean() < 0.5 * np.abs(movie - movie[0])[inner].mean()


def test_known_shift_demo():
    scene = simulate.drifting(1, (60, 60), np.zeros((1, 2)))[0]
    params = motion.MotionParams(strides=(20, 20), overlaps=(6, 6), max_shifts=(5, 5), filter_size_patch=3)
    moved, shifts = motion.shift_demo(scene, 40, (3, 0), params)
    # patches inside the box move back by it, those outside stay
    assert (shifts[:, 0] == -3).any() and (shifts[:, 0] <= -2).sum() >= 3 and (shifts == 0).all(axis=1).any() and moved.shape == scene.shape


def test_extraction_end_to_end(spark, save):
    rng = np.random.default_rng(9)
    spikes = rng.poisson(0.015, (400, 5)) * 3.0
    movie, truth = simulate.movie(spikes, (48, 48), seed=2, rate=20, size=3.0)
    params = ExtractionParams(
        patch_params=PatchParams((1, 2), 16),
        init_params=InitParams(gSig=(3, 3), gSiz=(8, 8), ssub=1, tsub=1, min_corr=0.5, min_pnr=1, thresh_init=0.5),
        temporal_params=TemporalParams(nb=2),
    )
    r = extraction.extract(frames(spark, movie), 48, 48, params, save)
    found = r.components.collect()
    centers = np.array([[np.average(np.array(c["px"]) // 48, weights=c["a"]), np.average(np.array(c["px"]) % 48, weights=c["a"])] for c in found])
    d = np.linalg.norm(centers[:, None] - truth["centers"], axis=2)
    hit = d.min(axis=0) < 4
    assert hit.mean() >= 0.8
    best = [max(np.corrcoef(found[i]["c"], truth["c"][:, k])[0, 1] for i in np.flatnonzero(d[:, k] < 4)) for k in np.flatnonzero(hit)]
    assert np.median(best) > 0.8
    assert r.background.count() == 2 and r.traces().select("k").distinct().count() == len(found)


def test_merge_joins_halves_of_a_cell(spark, save):
    c = (np.random.default_rng(1).random(200) > 0.95).astype(float)
    for t in range(1, 200):
        c[t] += 0.9 * c[t - 1]
    other = np.roll(c, 77)[::-1]
    rows_ = [
        (1, 0, [0, 1, 2], [1.0, 1.0, 0.5], c.tolist(), c.tolist(), c.tolist()),
        (2, 0, [1, 2, 3], [0.5, 1.0, 1.0], (0.9 * c + 0.01).tolist(), c.tolist(), c.tolist()),
        (3, 0, [3, 4], [1.0, 1.0], other.tolist(), other.tolist(), other.tolist()),
    ]
    df = spark.createDataFrame(rows_, f"k long, {extraction.COMPONENT}")
    out = extraction.merge_components(df, ExtractionParams(temporal_params=TemporalParams(p=0)), save).collect()
    assert sorted(r["k"] for r in out) == [1, 3] and sorted(next(r for r in out if r["k"] == 1)["px"]) == [0, 1, 2, 3]


def test_dff_leaves_out_bad_traces(spark):
    df = spark.createDataFrame([(k, t, float(v)) for k, base in ((1, 5), (2, 0), (3, 5)) for t, v in enumerate([base + i % 4 for i in range(30 if k < 3 else 8)])], "k long, t long, v double")
    assert {r["k"] for r in traces.dff(df, 10).select("k").distinct().collect()} == {1}


def test_foopsi_over_traces(spark):
    y = np.random.default_rng(2).gamma(1, 1, 300)
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(y)], "k long, t long, v double")
    r = traces.foopsi(df).first()
    assert len(r["c"]) == 300 and 0 < r["g"] < 1 and r["sn"] > 0


def test_sources(spark, tmp_path):
    from somaflow.sources import movies

    m = np.random.default_rng(3).integers(0, 255, (300, 6, 5)).astype(np.uint8)
    movies.write_avi(f"{tmp_path}/msCam1.avi", m[:200])
    movies.write_avi(f"{tmp_path}/msCam2.avi", m[200:])
    got = np.array([r["px"] for r in movies.load_movie(spark, f"{tmp_path}/msCam*.avi").orderBy("t").collect()])
    assert np.array_equal(got.reshape(m.shape), m)
    np.save(f"{tmp_path}/m.npy", m)
    df = movies.load_movie(spark, f"{tmp_path}/m.npy")
    assert df.count() == 300
    movies.write_frames(df, f"{tmp_path}/frames")
    part = movies.read_frames(spark, f"{tmp_path}/frames", 250, 260)
    assert sorted(r["t"] for r in part.collect()) == list(range(250, 260))
    with pytest.raises(ValueError):
        movies.load_movie(spark, "x.mp4")
    (tmp_path / "bad.avi").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        movies.avi_index(f"{tmp_path}/bad.avi")
    from somaflow.sources.videos import listed

    assert listed(spark, str(tmp_path)).count() == 3


def test_parameters(tmp_path):
    (tmp_path / "p.yaml").write_text("frame_rate: 20\nmotion_correction:\n  strides: !!python/tuple [30,30]\n  save_original: False\ncnmfe:\n  init_params:\n    gSig: !!python/tuple [3,3]\n  temporal_params:\n    solvers: !!python/list ['A']\n")
    p = load(f"{tmp_path}/p.yaml")
    assert p.frame_rate == 20 and p.motion_correction.strides == (30, 30) and p.cnmfe.init_params.gSig == (3, 3)
    assert default_parameters("motion_correction").nb_round == 5
    with pytest.raises(KeyError):
        default_parameters("x")
    (tmp_path / "q.yaml").write_text("a: !!python/object/apply:os.system ['true']\n")
    with pytest.raises(Exception):
        load(f"{tmp_path}/q.yaml")


def test_streaming_deconvolution_equals_batch(spark, tmp_path):
    from somaflow.functions.oasis import Pools
    from somaflow.streaming.oasis_stream import deconvolve_stream

    rng = np.random.default_rng(5)
    y = rng.gamma(1, 2, (2, 60))
    order = [(k, t) for t in range(60) for k in range(2)]
    for i in range(0, len(order), 30):  # frames swapped inside and between files, some twice
        part = order[i : i + 30][::-1] + ([(0, 0)] if i else [])
        spark.createDataFrame([(k, t, float(y[k, t])) for k, t in part], "k long, t long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k long, t long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen: dict = {}

    def take(df, epoch):
        for r in df.collect():
            seen[r["k"], r["t"]] = (r["c"], r["s"], r["late"])

    q = deconvolve_stream(stream, 0.9, 0.2).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(take).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for k in range(2):
        p = Pools(0.9, 0.2)
        for v in y[k]:
            p.fit_next(v)
        assert np.allclose([seen[k, t][0] for t in range(60)], p.c())
        assert np.allclose([seen[k, t][1] for t in range(60)], p.s(), atol=1e-9)
    assert max(v[2] for v in seen.values()) >= 1


def test_movie_api(spark, tmp_path):
    from somaflow import api
    from somaflow.functions.simulate import head_direction
    from somaflow.operators.decoding import angular_error, decoded

    m = api.Movie.of(spark, np.random.default_rng(0).random((40, 8, 8)), frame_rate=20, attrs={"animal_name": "a1"})
    m.save(f"{tmp_path}/movie")
    back = api.Movie.load(spark, f"{tmp_path}/movie")
    assert (back.h, back.w, back.duration, back.frame_rate, back.attrs) == (8, 8, 40, 20, {"animal_name": "a1"})
    assert api.correlation_info(back, 1).count() == 64
    np.savez(f"{tmp_path}/t.npz", 3 + np.random.default_rng(1).random((200, 4)))
    assert api.dff(api.load_traces(spark, f"{tmp_path}/t.npz"), 20, 1).count() == 800
    angle, spikes = head_direction(600, 12, peak=3)
    rate = simulate.decay(spikes, 0.1, 100)
    rows_ = spark.createDataFrame([(t, float(a), r.tolist()) for t, (a, r) in enumerate(zip(angle, rate))], "t long, angle double, features array<double>")
    out = decoded(rows_, classes=12, folds=2, trees=10, depth=5)
    assert out.count() == 600
    assert out.select(angular_error(out.angle, out.decoded).alias("e")).approxQuantile("e", [0.5], 0.01)[0] < 0.8


class HeldState:
    """What a state store does for one key."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_the_online_state_is_bounded():
    import pandas as pd

    from somaflow.functions.oasis import oasis_ar1
    from somaflow.streaming.oasis_stream import OnlineDeconvolution

    rng = np.random.default_rng(15)
    y, _ = traces_with_spikes(rng, 6000)
    p = OnlineDeconvolution(0.9, horizon=200, patience=50)
    p.state, rows, sizes = HeldState(), {}, []
    for a in range(0, len(y), 100):
        order = a + rng.permutation(100)
        order = order[order != 1234]  # a frame that never comes
        for pdf in p.handleInputRows((3,), iter([pd.DataFrame({"t": order, "v": y[order]})]), None):
            rows |= {t: (c, s) for t, c, s in zip(pdf["t"], pdf["c"], pdf["s"])}
        sizes.append(len(p.state.value[3]))
    assert max(sizes[10:]) <= 200 and len(p.state.value[7]) == 0 and sorted(rows) == list(range(6000))
    # the lost frame decays from the one before; all others are as in one batch over the trace filled so
    filled = y.copy()
    whole, _ = oasis_ar1(y[:1234], 0.9)
    filled[1234] = whole[-1] * 0.9
    c, s = oasis_ar1(filled, 0.9)
    assert np.allclose([rows[t][0] for t in range(6000)], c) and np.allclose([rows[t][1] for t in range(6000)], s)


def traces_with_spikes(rng, n):
    s = rng.poisson(0.05, n).astype(float)
    c = np.zeros(n)
    for t in range(1, n):
        c[t] = 0.9 * c[t - 1] + s[t]
    return c + 0.2 * rng.standard_normal(n), s


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from somaflow import folders

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        folders.shared_root(cluster)
    with folders.scratch(spark):
        path = folders.new_folder(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_ar1_filter_by_definition(spark):
    rows = [(0, t, v) for t, v in enumerate([1.0, 2.0, 0.0, -1.0])] + [(1, 0, 5.0)]
    got = {(r["k"], r["t"]): r["c"] for r in traces.ar1_filter(spark.createDataFrame(rows, "k long, t long, v double"), 0.5).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.5, (0, 2): 1.25, (0, 3): -0.375, (1, 0): 5.0}


def test_kernels_agree_with_the_graded_operators(spark):
    """The extraction works on arrays; each kernel gives what the operator of the same step gives, which SQL grades."""
    from somaflow.functions import extraction as fx
    from somaflow.functions import images
    from somaflow.operators import linear

    rng = np.random.default_rng(22)
    m = rng.random((40, 6, 8))
    a, c = rng.random((3, 48)) * (rng.random((3, 48)) > 0.4), rng.random((40, 3))
    df, px = frames(spark, m), None
    cn = {r["p"]: r["cn"] for r in stats.correlation_image(df, 6, 8).collect()}
    assert np.allclose([cn[p] for p in range(48)], fx.local_correlation(m).ravel())
    px = layout.pixels(df)
    down = {(r["t"], r["y"], r["x"]): r["v"] for r in layout.downsampled(df, 8, 2, 4).collect()}
    assert np.allclose([down[k] for k in np.ndindex(10, 3, 4)], images.area_down(m, 2, 4).ravel())
    foot = spark.createDataFrame([(k, p, float(a[k, p])) for k in range(3) for p in range(48) if a[k, p]], "k long, p int, a double")
    trace = spark.createDataFrame([(k, t, float(c[t, k])) for k in range(3) for t in range(40)], "k long, t long, v double")
    rest = {(r["t"], r["k"]): r["v"] for r in linear.residual_traces(px, foot, trace).collect()}
    assert np.allclose([rest[k] for k in np.ndindex(40, 3)], fx.residual_traces(m.reshape(40, -1), a, c).ravel())
    unit = fx.normalised(a, c)[0]
    assert all(np.isclose(r["a"], unit[r["k"], r["p"]]) for r in linear.unit_footprints(foot).collect())


def test_video_catalogue_reads_containers(spark, tmp_path):
    from somaflow.sources import movies, videos

    rng = np.random.default_rng(3)
    for num, n in ((10, 7), (2, 300), (1, 5)):
        movies.write_avi(f"{tmp_path}/msCam{num}.avi", rng.integers(0, 256, (n, 6, 9)))
    got = videos.catalogue(spark, f"{tmp_path}/msCam*.avi", "m").orderBy("start").collect()
    assert [(r["movie"], r["num"], r["duration"], r["h"], r["w"], r["start"], r["stop"]) for r in got] == [("m", 0, 5, 6, 9, 0, 5), ("m", 1, 300, 6, 9, 5, 305), ("m", 9, 7, 6, 9, 305, 312)]
    assert videos.catalogue(spark, f"{tmp_path}/none*.avi").count() == 0


def test_histogram_ranges(spark):
    v = np.random.default_rng(4).normal(size=500)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    count = lambda *a, d=df: {r["bin"]: r["n"] for r in stats.histogram(d, "v", *a).collect()}
    want = lambda n: {k: c for k, c in enumerate(n.tolist()) if c}
    assert count(9) == want(np.histogram(v, 9)[0])
    assert count(8, -0.5, 1.5) == want(np.histogram(v, 8, (-0.5, 1.5))[0])
    assert count(4, d=spark.createDataFrame([(3.0,)] * 5, "v double")) == want(np.histogram([3.0] * 5, 4)[0])
    assert count(4, d=spark.createDataFrame([], "v double")) == {}


def test_odd_values_in_statistics(spark):
    m = spark.createDataFrame([(0, [1.0, 1.0, 1.0]), (1, [0.0, 2.0, 4.0])], "t long, px array<double>")
    assert [r["total"] for r in stats.projection_image(m).orderBy("p").collect()] == [0.0, 0.5, 1.0]
    parts = {r["p"]: r["part"] for r in stats.seed_correlations(m.selectExpr("t", "array(px[0], -px[1], -px[2], 5.0D) AS px"), 0).collect()}
    assert parts == {0: "neuron", 1: "neuron", 2: "neuron", 3: "between"}
    noise = spark.createDataFrame([(0, 0.0), (1, 1.5), (2, 9.0)], "p int, sn double")
    assert [(r["v"], r["kept"]) for r in stats.thresholded(m, noise, 1.0).orderBy("t", "p").collect()] == [(1.0, True), (0.0, False), (0.0, False), (0.0, True), (2.0, True), (0.0, False)]
    t = spark.createDataFrame([(1, 0, -2.0), (1, 1, 7.0), (1, 2, None)], "k long, t long, v double")
    assert [r["v"] for r in traces.clipped(t, 0, 5).orderBy("t").collect()] == [0.0, 5.0, None]


def test_arrows_and_dots_of_a_field(spark):
    shifts = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 2, 0.5, 0.0)], "i int, j int, dy double, dx double")
    still, moved = geometry.vector_field(shifts, 10, 10, (4, 4), (6, 6)).orderBy("i").collect()
    assert (still["u"], still["v"], still["xp"], still["yp"]) == (None, None, 3.0, 3.0)
    assert (moved["x"], moved["y"], moved["u"], moved["v"], moved["xp"]) == (10.0, 7.0, 0.0, 0.5, None)


@pytest.mark.parametrize("tile", [7, 8192])
def test_overlaps_by_tiles_equal_the_join_on_pixels(spark, monkeypatch, save, tile):
    """Blocks that are smaller than a patch, footprints in two patches, infinite and absent weights, names that are null."""
    from somaflow.operators import graph

    monkeypatch.setattr(geometry, "TILE", tile)
    monkeypatch.setattr(geometry, "PAIRS", 50)
    rng = np.random.default_rng(5)
    data = [(k, k % 3, int(p), float(rng.random())) for k in range(60) for p in rng.choice(40, 6, replace=False)]
    data += [(k, 1, int(p), 0.5) for k in (0, 3, 6, 9) for p in (3, 4)] + [(7, 1, 1, float("inf")), (10, 1, 2, float("nan")), (None, 1, 3, 1.0), (11, None, 3, 1.0), (13, 1, 3, 0.25), (13, 1, 3, 0.25)]
    f = spark.createDataFrame(data, "k long, patch int, p int, a double")
    want = {(r["i"], r["j"]): r["overlap"] for r in geometry._pixel_join(f, ["p", "patch"]).collect()}
    got = geometry.overlap_graph(f, "patch").collect()
    assert len(got) == len(want) and all(np.isclose(r["overlap"], want[r["i"], r["j"]], equal_nan=True) for r in got)
    strong = {p for p, v in want.items() if not round(v, 6) <= 0.7}
    assert {r["k"] for r in geometry.overlapping(f, "patch", 0.7).collect()} == {k for p in strong for k in p}
    root = {k: k for p in strong for k in p}
    while any(root[i] != root[j] for i, j in strong):
        for i, j in strong:
            root[i] = root[j] = min(root[i], root[j])
    links = geometry.overlap_links(f, "patch", 0.7)
    assert {(r["i"], r["j"]) for r in links.collect()} and {r["k"]: r["root"] for r in graph.connected(links, save).collect()} == root


def test_no_pair_of_a_patch_is_shuffled(spark):
    """Only footprints are: what an aggregate of pairs would sort isn't there."""
    f = spark.createDataFrame([(1, 0, 1, 1.0), (2, 0, 1, 1.0)], "k long, patch int, p int, a double")
    plan = geometry.overlap_links(f, "patch", 0.4)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and geometry.overlap_links(f, "patch", 0.4).count() == 1


def _shuffled(spark) -> dict[int, int]:
    """Bytes that stages have written to shuffles, by stage; only the latest thousand are known."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return {(s := stages.apply(n)).stageId(): s.shuffleWriteBytes() for n in range(stages.size())}


def test_footprints_are_stored_once_whatever_number_of_blocks_they_meet(spark, monkeypatch):
    """A patch as one block, then as ten of about four footprints: what is shuffled doesn't grow with the tiles."""
    rng = np.random.default_rng(8)
    f = spark.createDataFrame([(k, 0, p, float(rng.random())) for k in range(40) for p in range(300)], "k long, patch int, p int, a double").cache()
    f.count()
    made, got = [], []
    for tile in (40, 4):
        monkeypatch.setattr(geometry, "TILE", tile)
        before = max(_shuffled(spark))
        got.append({(r["i"], r["j"]): r["overlap"] for r in geometry.overlap_graph(f, "patch").collect()})
        made.append(sum(v for k, v in _shuffled(spark).items() if k > before))
    f.unpersist()
    assert made[0] > 0 and made[1] < 1.5 * made[0], made
    assert len(got[0]) == 40 * 39 // 2 and got[0].keys() == got[1].keys() and all(np.isclose(v, got[1][p]) for p, v in got[0].items())


def test_wide_footprints_get_more_blocks(spark, monkeypatch):
    """A block's weights are bounded as its footprints are; pairs stay whole, of footprints of several patches too."""
    monkeypatch.setattr(geometry, "WEIGHTS", 40)
    data = [(k, g, p, 1.0 + k) for k in range(30) for g in ("a", "b") if k % 5 == 0 or g == "a" for p in range(k, k + 12)]
    f = spark.createDataFrame(data, "k long, patch string, p int, a double")
    assert geometry.laid(f, "patch").where("g = 'a'").count() > 3
    want = {(r["i"], r["j"]): r["overlap"] for r in geometry._pixel_join(f, ["p", "patch"]).collect()}
    assert want and {(r["i"], r["j"]): r["overlap"] for r in geometry.overlap_graph(f, "patch", 6).collect()} == want


def test_odd_patches_and_weights_meet_as_in_the_join_on_pixels(spark, monkeypatch):
    """Patches named NaN, weights and pixels that are null, weights of nought and below; a table without rows."""
    monkeypatch.setattr(geometry, "TILE", 4)
    nan = float("nan")
    data = [(k, (nan, 1.0)[k % 2], p, 0.5 + k) for k in range(12) for p in (k % 3, 5)]
    data += [(1, 1.0, 9, None), (3, 1.0, 9, 1.0), (5, 1.0, 9, 0.0), (7, 1.0, 9, -1.0), (1, 1.0, None, 2.0), (3, 1.0, None, 2.0)]
    for rows in (data, []):
        f = spark.createDataFrame(rows, "k long, patch double, p int, a double")
        want = {(r["i"], r["j"]): r["overlap"] for r in geometry._pixel_join(f, ["p", "patch"]).collect()}
        assert {(r["i"], r["j"]): r["overlap"] for r in geometry.overlap_graph(f, "patch").collect()} == want and bool(want) == bool(rows)


def test_overlaps_are_rounded_as_spark_rounds(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    half = (rng.integers(0, 10**7, 500) + 0.5) / 1e6
    v = np.concatenate(([0.0, -0.0, 4e-7, -4e-7, 5e-7, 1.0000005, 1.0000015, 1e15, 1.7e308, 5e-324, np.inf, -np.inf, np.nan], half, np.nextafter(half, 9), np.nextafter(half, -1), -half, 10 ** rng.uniform(-9, 12, 500)))
    want = spark.createDataFrame([(n, float(x)) for n, x in enumerate(v)], "n long, v double").select("n", (F.round("v", 6) + F.lit(0.0)).alias("v")).orderBy("n").collect()
    got = geometry.rounded(v, 6)
    assert np.array_equal(got, [r["v"] for r in want], equal_nan=True) and not np.signbit(got[1]) and not np.signbit(got[3])


def test_products_of_sparse_rows_get_more_tasks_and_not_larger_ones(spark, monkeypatch):
    from somaflow.operators import linear

    monkeypatch.setattr(linear, "TASK_PRODUCTS", 16)
    rng = np.random.default_rng(2)
    dense = rng.integers(0, 3, (40, 30)).astype(float)
    rows = spark.createDataFrame([(int(o), int(k), float(dense[o, k])) for o, k in zip(*np.nonzero(dense))], "o long, k long, v double")
    out = linear.gram(rows, "o", "k", "v")
    assert "hashpartitioning(i" in out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = dense.T @ dense
    assert {(r["i"], r["j"]): r["v"] for r in out.collect()} == {(i, j): want[i, j] for i in range(30) for j in range(i, 30) if want[i, j]}
