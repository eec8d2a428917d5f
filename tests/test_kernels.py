"""Numerical kernels against closed forms and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from somaflow.functions import extraction as fx
from somaflow.functions import images, oasis, registration, simulate
from somaflow.operators.motion import MotionParams
from somaflow.operators.stats import spectrum_noise
from somaflow.params import InitParams, SpatialParams, TemporalParams


def max_min(y, g, lam):
    """Closed form of the pooled solution for s_min = 0."""
    n = len(y)
    z = y - lam * (1 - g)
    z[-1] = y[-1] - lam
    out = np.zeros(n)
    for t in range(n):
        best = -np.inf
        for i in range(t + 1):
            low = min(sum(z[k] * g ** (k - i) for k in range(i, j + 1)) / sum(g ** (2 * (k - i)) for k in range(i, j + 1)) for j in range(t, n))
            best = max(best, low * g ** (t - i))
        out[t] = max(0, best)
    return out


@given(st.lists(st.floats(-5, 10), min_size=1, max_size=14), st.sampled_from([0.5, 0.8, 0.95]), st.sampled_from([0.0, 0.7]))
@settings(max_examples=60, deadline=None)
def test_oasis_is_the_max_min(values, g, lam):
    y = np.array(values)
    c, s = oasis.oasis_ar1(y, g, lam)
    assert np.allclose(c, max_min(y.copy(), g, lam), atol=1e-8)
    assert (c[1:] >= g * c[:-1] - 1e-9).all() and (s >= -1e-9).all()


def test_oasis_threshold_on_spikes():
    c, s = oasis.oasis_ar1(np.array([0, 3, 2.4, 1.9, 0.5, 5, 4.1, 3.2]), 0.8, 0, 1.0)
    assert (s[s > 1e-9] >= 1.0 - 1e-9).all()


def test_online_equals_batch():
    y = np.random.default_rng(0).gamma(1, 2, 200)
    p = oasis.Pools(0.9, 0.3)
    for v in y:
        p.fit_next(v)
    q = oasis.Pools(0.9, 0.3).look_ahead(list(y))
    assert np.allclose(p.c(), q.c()) and np.allclose(p.c(5), p.c()[-5:])
    assert p.last_length() >= 1 and np.isclose(p.last_value(), p.c()[-1])


@pytest.fixture(scope="module")
def traces():
    rng = np.random.default_rng(1)
    s = rng.poisson(0.03, (600, 12)) * rng.uniform(1, 2, (600, 12))
    c = s.copy()
    for t in range(1, 600):
        c[t] += 0.92 * c[t - 1]
    return s, c, c + 0.3 * rng.standard_normal(c.shape) + 2


def test_constrained_deconvolution_recovers(traces):
    s, c, y = traces
    for k in range(12):
        r = oasis.constrained_foopsi(y[:, k], fudge=1.0, noise_method="logmexp")
        assert np.corrcoef(r["c"], c[:, k])[0, 1] > 0.93
        residual = y[:, k] - r["c"] - r["bl"]
        assert abs(residual @ residual / 600 - r["sn"] ** 2) < 0.35 * r["sn"] ** 2
        assert 0.8 < r["g"] < 0.99 and abs(r["sn"] - 0.3) < 0.06 and abs(r["bl"] - 2) < 0.5


def test_decay_refinement_and_l0(traces):
    s, c, y = traces
    r = oasis.constrained_oasis(y[:, 0], 0.85, 0.3, optimize_g=5)
    assert abs(r[3] - 0.92) < 0.06
    r = oasis.constrained_oasis(y[:, 0], 0.92, 0.3, penalty=0)
    assert np.corrcoef(r[0], c[:, 0])[0, 1] > 0.9 and r[4] == 0


def test_time_constant(traces):
    s, c, y = traces
    g = [oasis.time_constant(y[:, k], 0.3)[0] for k in range(12)]
    assert abs(np.median(g) - 0.92) < 0.05
    assert len(oasis.time_constant(y[:, 0], 0.3, p=2)) == 2


def test_online_nnls_matches_pools_on_clean_data():
    s = np.zeros(150)
    s[[10, 40, 41, 90]] = [1, 2, 1, 3]
    c = s.copy()
    for t in range(1, 150):
        c[t] += 0.9 * c[t - 1]
    got, spikes = oasis.online_nnls(c, 0.9, shift=30, window=60)
    assert np.allclose(got, c, atol=1e-5) and np.allclose(spikes, s, atol=1e-5)


def test_nnls_conditions():
    rng = np.random.default_rng(2)
    k = rng.standard_normal((30, 8))
    y = rng.standard_normal(30)
    s = oasis.nnls(k.T @ k, k.T @ y)
    grad = k.T @ (y - k @ s)
    assert (s >= 0).all() and (grad <= 1e-6).all() and np.abs(grad[s > 0]).max(initial=0) < 1e-6


def test_unsupported_order():
    with pytest.raises(NotImplementedError):
        oasis.constrained_foopsi(np.ones(50), p=3)


def test_spectrum_noise_of_white_noise():
    y = np.random.default_rng(3).standard_normal((40, 1000))
    assert abs(spectrum_noise(y, "mean", exact=True).mean() - 1) < 0.03
    with pytest.raises(ValueError):
        spectrum_noise(y, "mode")


# -- images


def test_filters():
    assert np.allclose(images.band_pass(np.ones((1, 12, 12)), 2), 0)
    assert np.allclose(images.centred_gaussian(np.full((1, 12, 12), 7.0), 2), 0)
    assert np.isclose(images.gaussian(13, 4).sum(), 1) and images.kernel_size(4) == 13


def test_label_and_morphology():
    m = np.zeros((6, 7), bool)
    m[0, 0] = m[1, 1] = m[4, 5] = m[4, 6] = True
    assert images.label(m).max() == 2 and images.label(m)[0, 0] == images.label(m)[1, 1] == 1
    assert images.dilate(m).sum() > m.sum()
    ring = np.ones((3, 3), bool)
    ring[1, 1] = False
    assert images.closing(np.pad(ring, 2)).sum() == 9


def test_area_down_and_center():
    b = np.arange(2 * 4 * 4, dtype=float).reshape(2, 4, 4)
    assert np.allclose(images.area_down(b, 2, 2), b.reshape(2, 2, 2, 2, 2).mean(axis=(0, 2, 4)))
    dot = np.zeros((5, 5))
    dot[3, 1] = 2
    assert np.allclose(images.center_of_mass(dot), [3, 1])


def test_linear_up():
    ramp = np.add.outer(np.arange(4.0), np.arange(5.0))[None]
    assert np.allclose(images.linear_up(ramp, 4, 5), ramp)
    big = images.linear_up(ramp, 8, 10)
    assert big.shape == (1, 8, 10) and np.allclose(np.diff(big[0, 1:-1, 1:-1], axis=1), 0.5)


def test_patch_fit_on_a_smaller_movie(simulated):
    y, truth = simulated
    from somaflow.params import ExtractionParams

    p = ExtractionParams(init_params=InitParams(gSig=(3, 3), gSiz=(8, 8), ssub=2, tsub=2, min_corr=0.5, min_pnr=1, thresh_init=0.5), temporal_params=TemporalParams(nb=3))
    r = fx.fit_patch(y, p)
    n, d = len(y), y[0].size
    assert r["a"].shape == (len(r["a"]), d) and r["c"].shape == (n, len(r["a"])) and r["b"].shape == (3, d) and r["f"].shape == (n, 3)
    best = [max((np.corrcoef(r["c"][:, k], truth["c"][:, j])[0, 1] for k in range(len(r["a"]))), default=0) for j in range(6)]
    assert np.mean(np.array(best) > 0.7) >= 0.5


def test_circular_constraint_keeps_one_blob():
    y, x = np.mgrid[:21, :21]
    a = np.exp(-((y - 6) ** 2 + (x - 6) ** 2) / 8) + 0.4 * np.exp(-((y - 15) ** 2 + (x - 15) ** 2) / 8)
    a = np.where(a < 0.05, 0, a)
    out = images.circular_constraint(a)
    assert out[6, 6] == a[6, 6] and out[15, 15] == 0


# -- registration


@pytest.mark.parametrize("shift", [(3, 0), (-2, 4), (0, 0)])
def test_integer_shift(shift):
    scene = simulate.drifting(1, (48, 40), np.zeros((1, 2)))[0]
    got, error, _ = registration.register(np.roll(scene, shift, (0, 1)), scene, 1, (8, 8))
    assert tuple(got) == shift and error < 1e-3


def test_sub_pixel_shift():
    scene = simulate.drifting(1, (64, 64), np.zeros((1, 2)))[0]
    f = np.fft.fft2(scene)
    ky, kx = np.fft.fftfreq(64)[:, None], np.fft.fftfreq(64)
    moved = np.fft.ifft2(f * np.exp(-2j * np.pi * (ky * 1.5 - kx * 0.5))).real
    got, _, _ = registration.register(moved, scene, 2, (5, 5))
    assert np.allclose(got, [1.5, -0.5])


def test_rigid_shift_and_translate():
    scene = simulate.drifting(1, (60, 60), np.zeros((1, 2)))[0]
    moved = registration.translate(scene, (2, -1))
    back = registration.rigid_shift(moved, registration.rigid_matcher(scene, 5, 4), 4)
    assert np.allclose(back, (-2, 1), atol=0.2)
    assert np.allclose(registration.translate(moved, (-2, 1))[6:-6, 6:-6], scene[6:-6, 6:-6], atol=1.0)
    assert np.allclose(registration.translate(scene, (0, 0)), scene)
    assert np.isfinite(registration.translate(scene, (3, 2), border_nan=True)).all()


def test_piecewise_moves_towards_template():
    params = MotionParams(strides=(24, 24), overlaps=(6, 6), max_shifts=(4, 4), filter_size_patch=3, filter_size=5, max_deviation_rigid=4)
    scene = simulate.drifting(1, (60, 60), np.zeros((1, 2)))[0]
    moved = registration.translate(scene, (2, 1))
    target = registration.Target(scene, params)
    out = registration.correct_frame(moved, target)
    inner = slice(8, -8)
    assert np.abs(out - scene)[inner, inner].mean() < 0.3 * np.abs(moved - scene)[inner, inner].mean()
    assert np.allclose(registration.piecewise_correct(scene, target), scene)


def test_patches_are_filtered_by_themselves():
    """Each crop of image and template is filtered alone; moved patches are filled with their mean at the border."""
    params = MotionParams(strides=(20, 20), overlaps=(4, 4), max_shifts=(4, 4), filter_size_patch=3, filter_size=5, max_deviation_rigid=4, upsample_factor=2)
    a, b = simulate.drifting(2, (60, 50), np.array([(0, 0), (1.5, -2)]))
    target = registration.Target(a, params)
    for (_, y0, y1, x0, x1), shift in zip(target.patches, target.shifts(b)):
        if min(y1 - y0, x1 - x0) > 1:
            one, two = (images.band_pass(i[None, y0:y1, x0:x1], 3)[0] for i in (b, a))
            assert np.allclose(shift, -registration.register(one, two, 2, (4, 4))[0])


def test_maps_equal_windows_taken_one_by_one():
    rng = np.random.default_rng(20)
    block, template, most = rng.standard_normal((3, 30, 26)) + 5, rng.standard_normal((30, 26)), 4
    block[2] = 7.5
    maps = registration.ncc_maps(block, template, most)
    inner = template[most:-most, most:-most]
    for i in range(2 * most + 1):
        for j in range(2 * most + 1):
            for k in range(2):
                assert np.isclose(maps[k, i, j], np.corrcoef(block[k, i : i + 22, j : j + 18].ravel(), inner.ravel())[0, 1])
    assert (maps[2] == 0).all() and (registration.ncc_maps(block, np.ones((30, 26)), most) == 0).all()


def test_large_kernels_equal_their_definition():
    rng = np.random.default_rng(21)
    x, kernel = rng.standard_normal((2, 40, 33)), rng.standard_normal((15, 13))
    padded = np.pad(x, ((0, 0), (7, 7), (6, 6)), mode="symmetric")
    want = sum(kernel[i, j] * padded[:, i : i + 40, j : j + 33] for i in range(15) for j in range(13))
    assert np.allclose(images.correlate(x, kernel, "reflect"), want)


def test_resize_field_keeps_constants():
    assert np.allclose(registration.resize_field(np.full((3, 4), 2.5), (6, 8)), 2.5)


# -- decay of second order, decimation, the wrapper


def second_order(rng, n, g=(1.7, -0.712), sn=0.3, base=2.0):
    s = (rng.random(n) < 0.03) * (1 + rng.random(n))
    c = np.zeros(n)
    for t in range(n):
        c[t] = s[t] + (g[0] * c[t - 1] if t else 0) + (g[1] * c[t - 2] if t > 1 else 0)
    return c + base + sn * rng.standard_normal(n), c, s


def test_second_order_reaches_the_noise_and_finds_the_activity():
    y, c, s = second_order(np.random.default_rng(3), 600)
    r = oasis.constrained_foopsi(y, g=(1.7, -0.712), sn=0.3, p=2)
    left = y - r["bl"] - r["c"]
    assert np.isclose(left @ left / 600, 0.09, rtol=0.02) and r["lam"] > 0 and (r["s"] >= 0).all()
    assert np.corrcoef(r["c"], c)[0, 1] > 0.97 and abs(r["bl"] - 2) < 0.3
    # c follows its recursion from s
    again = np.zeros(600)
    for t in range(600):
        again[t] = r["s"][t] + 1.7 * (again[t - 1] if t else 0) - 0.712 * (again[t - 2] if t > 1 else 0)
    assert np.allclose(again, r["c"], atol=1e-6)
    near = np.convolve(s > 0, np.ones(5), "same") > 0
    assert r["s"][near].sum() > 0.8 * r["s"].sum()
    kept = oasis.constrained_foopsi(y, g=(1.7, -0.712), sn=0.3, p=2, bl=2.0)
    assert kept["bl"] == 2.0
    own = oasis.constrained_foopsi(y, p=2, noise_method="logmexp", fudge=1.0)
    assert 0 < own["decay"] < 1 and np.corrcoef(own["c"], c)[0, 1] > 0.8
    for short in (0, 1, 2):
        assert len(oasis.constrained_ar2(np.ones(short), (1.7, -0.712), 0.3)[0]) == short


def test_decimation_ends_near_the_whole_trace():
    rng = np.random.default_rng(4)
    s = (rng.random(3000) < 0.02) * 2.0
    c = np.zeros(3000)
    for t in range(1, 3000):
        c[t] = 0.95 * c[t - 1] + s[t]
    y = c + 1 + 0.3 * rng.standard_normal(3000)
    whole, quick = (oasis.constrained_oasis(y, 0.95, 0.3, decimate=d) for d in (1, 5))
    assert np.corrcoef(whole[0], quick[0])[0, 1] > 0.99 and abs(whole[2] - quick[2]) < 0.1
    left = y - quick[2] - quick[0]
    assert np.isclose(left @ left / 3000, 0.09, rtol=0.05)


def test_wrapper_of_options():
    assert oasis.deconvolve_ca() == oasis.OPTIONS and oasis.deconvolve_ca(p=2)["p"] == 2
    y = second_order(np.random.default_rng(5), 300, (0.9, 0.0))[0]
    c, s, o, bl, c1 = oasis.deconvolve_ca(y, sn=0.3)
    r = oasis.constrained_foopsi(y, sn=0.3, noise_method="logmexp", fudge=1.0, optimize_g=1)
    assert np.allclose(c + c1 * r["decay"] ** np.arange(300), r["c"]) and bl == r["bl"] and o["g"] == [r["g"]] and o["sn"] == 0.3 and np.allclose(s, r["s"])
    with pytest.raises(KeyError):
        oasis.deconvolve_ca(y, unknown=1)


def test_pools_can_be_read_and_set():
    p = oasis.Pools(0.9)
    for v in (3.0, 1.0, 5.0):
        p.fit_next(v)
    one = p.pool(0)
    p.set_pool(0, (one[0] + 1, *one[1:]))
    assert p.pool(0)[0] == one[0] + 1 and p.pool(0)[1:] == one[1:]


def test_missing_samples_are_interpolated():
    m = np.arange(24.0).reshape(6, 2, 2)
    gaps = m.copy()
    gaps[0, 0, 0] = gaps[3, 0, 1] = gaps[5, 1, 0] = np.nan
    gaps[:, 1, 1] = np.nan
    out = fx.without_nan(gaps)
    assert out[0, 0, 0] == m[1, 0, 0] and out[3, 0, 1] == m[3, 0, 1] and out[5, 1, 0] == m[4, 1, 0] and (out[:, 1, 1] == 0).all() and fx.without_nan(m) is m


@pytest.mark.parametrize("size", [2, 3, 4])
def test_window_maxima(size):
    x = np.random.default_rng(6).standard_normal((9, 7))
    top = fx.window_maxima(x, size)
    for y0 in range(9):
        for x0 in range(7):
            rows, cols = (slice(max(0, k - size // 2), k + size - size // 2) for k in (y0, x0))
            assert top[y0, x0] == x[rows, cols].max()


# -- extraction


def test_lasso_conditions():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 5))
    g, t = x.T @ x / 80, x.T @ (x @ [1, 0, 2, 0, 0.1] + 0.1 * rng.standard_normal(80)) / 80
    a = fx.nonneg_lasso(g, t, 0.2)
    grad = t - g @ a
    assert (a >= 0).all() and (grad <= 0.2 + 1e-6).all() and np.allclose(grad[a > 0], 0.2, atol=1e-6)


def test_threshold_component():
    a = np.zeros((12, 12))
    a[2:6, 2:6] = 1
    a[9:11, 9:11] = 0.3
    out = fx.threshold_component(a.ravel(), (12, 12)).reshape(12, 12)
    assert out[3, 3] > 0 and out[9:, 9:].sum() == 0
    assert not fx.threshold_component(np.zeros(144), (12, 12)).any()
    assert fx.threshold_component(a.ravel(), (12, 12), "max").any()


def test_ring_background_reconstructs_smooth():
    rng = np.random.default_rng(5)
    f = rng.standard_normal((200, 3))
    yy, xx = np.mgrid[:16, :16] / 16
    y = f @ np.stack([yy.ravel(), xx.ravel(), (yy * xx).ravel()]) + 5
    b = fx.ring_background(y, np.zeros((0, 256)), np.zeros((200, 0)), (16, 16), 4)
    assert np.abs(y - b).mean() < 0.02


def test_nmf_recovers_rank_one_and_falls():
    rng = np.random.default_rng(6)
    v = np.outer(rng.random(30), rng.random(20))
    w, h = fx.nmf(v, 1)
    assert np.allclose(w @ h, v, atol=1e-6) and (w >= 0).all() and (h >= 0).all()
    b, f = fx.low_rank_background(rng.random((20, 3)) @ rng.random((3, 50)), 3)
    assert b.shape == (3, 50) and f.shape == (20, 3)


def test_compressed_background():
    rng = np.random.default_rng(7)
    b, f = rng.random((6, 80)), rng.random((40, 6))
    s, g = fx.compressed_background(b, f, 4)
    assert np.allclose(np.linalg.norm(s, axis=1), 1) and np.linalg.norm(f @ b - g @ s) < 0.2 * np.linalg.norm(f @ b)


def test_groups_do_not_overlap():
    o = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1]], bool)
    assert fx.independent_groups(o) == [[0, 2], [1]]


def test_merged_component_is_rank_one():
    rng = np.random.default_rng(8)
    a, c = rng.random(30), rng.random(100).cumsum() % 3
    one, trace, s = fx.merged_component(np.stack((a, 0.5 * a)), np.stack((c, c), axis=1), TemporalParams(p=0))
    assert np.corrcoef(one, a)[0, 1] > 0.999 and np.corrcoef(trace, c)[0, 1] > 0.99


@pytest.fixture(scope="module")
def simulated():
    rng = np.random.default_rng(9)
    spikes = rng.poisson(0.015, (500, 6)) * 3.0
    return simulate.movie(spikes, (48, 48), seed=4, rate=20, size=3.0, background=True)


def test_seeds_and_sweeps_find_cells(simulated):
    y, truth = simulated
    p = InitParams(gSig=(3, 3), gSiz=(8, 8), min_corr=0.5, min_pnr=1, thresh_init=0.5, ring_size_factor=1.5)
    a, c, centers = fx.seed_neurons(y, p)
    near = [np.linalg.norm(centers - t, axis=1).min() if len(centers) else 99 for t in truth["centers"]]
    assert np.mean(np.array(near) < 4) >= 0.8
    flat = y.reshape(len(y), -1)
    back = fx.ring_background(flat, a.reshape(len(a), -1), c, (48, 48), 12)
    a2, c2, s2 = fx.update_temporal(flat - back, a.reshape(len(a), -1), c, TemporalParams())
    a3, c3 = fx.update_spatial(flat - back, a2, c2, spectrum_noise(flat.T, "mean"), (48, 48), SpatialParams())
    assert len(a3) and c3.shape == (500, len(a3)) and fx.residual_traces(flat - back, a3, c3).shape == c3.shape
    n, cn = fx.normalised(a3, c3)
    assert np.allclose((n**2).sum(axis=1), 1) and np.allclose(cn @ n, c3 @ a3)


def test_joined_patches():
    from somaflow.functions import registration
    from somaflow.operators.geometry import motion_patches

    image = np.random.default_rng(8).random((20, 26))
    patches = motion_patches(20, 26, (6, 7), (4, 4))
    parts, corners = [image[a:b, c:d] for _, a, b, c, d in patches], [(a, c) for _, a, _, c, _ in patches]
    for gentle in (True, False):
        np.testing.assert_allclose(registration.join_patches(image, parts, corners, (4, 4), gentle), image)
    holed = [p.copy() for p in parts]
    holed[0][:2, :2] = np.nan
    np.testing.assert_allclose(registration.join_patches(image, holed, corners, (4, 4), True), image)
    moved = registration.join_patches(image, [p + 1 for p in parts], corners, (4, 4), False)
    np.testing.assert_allclose(moved, image + 1)
    field = np.zeros((2, 2, 2))
    field[0, 0, 1] = 1.0
    assert registration.shear(np.zeros((2, 2, 2))) == 0 and registration.shear(field) == 1.0
