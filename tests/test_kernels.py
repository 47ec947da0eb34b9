"""NumPy kernels on small arrays whose answers are known."""

import numpy as np
import pytest

from framelake.kernels import denoise, images, lowrank
from framelake.operators import factors, pixel
from framelake.operators.graph import greedy_colours
from framelake.plans import movies


def smooth(n=32, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, n))
    f = np.exp(-(np.fft.fftfreq(n)[:, None] ** 2 + np.fft.fftfreq(n)[None] ** 2) / 0.02)
    return np.fft.ifft2(np.fft.fft2(x) * f).real


@pytest.mark.parametrize("shift", [(2.0, -1.0), (0.3, 0.0), (-1.25, 2.5)])
def test_shift_is_found(shift):
    t = smooth()
    dy, dx = images.estimate_shift(images.shift_frame(t, *shift), t, (5, 5))
    assert abs(dy + shift[0]) < 0.01 and abs(dx + shift[1]) < 0.01


def test_impulse_and_constant():
    k = images.gaussian_highpass(1.0, 1.0)
    assert abs(k.sum()) < 1e-12
    assert np.allclose(images.convolve(np.ones((1, 9, 9)), k), 0)
    with pytest.raises(ValueError):
        images.gaussian_highpass(0, 1)


def test_blocks_and_weights():
    assert images.block_starts(10, 4) == [0, 2, 4, 6]
    assert images.block_starts(9, 4) == [0, 2, 4, 5]
    assert images.pyramid_weights(5, 7)[2, 3] == 3


def test_inpaint_keeps_the_rest():
    x, m = smooth(12), np.zeros((12, 12), bool)
    m[4:6, 4:6] = True
    y = images.inpaint(x, m)
    assert (y[~m] == x[~m]).all() and np.isfinite(y).all()


def test_rank_one_block():
    rng = np.random.default_rng(1)
    x = np.outer(np.abs(smooth(12)).ravel(), np.sin(np.arange(60) / 4))
    u, v = lowrank.decompose_block(x, (12, 12), 3, None, 1, rng)
    assert np.allclose(u @ v, x, atol=1e-8) and np.allclose(u.T @ u, np.eye(u.shape[1]))


def test_components_of_a_noise_block():
    """None passes, and those up to and with the n-th failure stay, whatever n; flat ones go after that."""
    x = np.random.default_rng(2).normal(size=(144, 80))
    for failures in (1, 2):
        u, v = lowrank.decompose_block(x, (12, 12), 4, (0.1, 0.1), failures, np.random.default_rng(0))
        assert u.shape[1] == failures and v.shape[0] == failures
    u, v = lowrank.decompose_block(np.zeros((144, 80)), (12, 12), 2, (0.1, 0.1), 1, np.random.default_rng(0))
    assert u.shape[1] == 0 and v.shape[0] == 0


def test_block_by_bins_and_denoiser():
    x = np.outer(np.abs(smooth(12)).ravel(), np.sin(np.arange(60) / 4)) + np.outer(smooth(12, 1).ravel(), np.cos(np.arange(60) / 7))
    u, v = lowrank.decompose_block(x, (12, 12), 2, None, 1, np.random.default_rng(0), 2, 2, lambda t: t)
    assert np.allclose(u @ v, x, atol=1e-6)
    low = lowrank.binned(np.arange(50.0).reshape(25, 2), (5, 5), 2, 1)
    assert low[0, 0] == np.mean([0, 2, 10, 12]) and low.shape == (4, 2)
    assert lowrank.binned(np.arange(5.0)[None], (1, 1), 1, 2)[0].tolist() == [0.5, 2.5, 4]


def test_highpass_passes_and_stops():
    b, a = lowrank.butterworth_highpass(5, 10, 100)
    t = np.arange(600) / 100
    fast, slow = np.sin(2 * np.pi * 30 * t), np.sin(2 * np.pi * 0.5 * t)
    out = lowrank.zero_phase(b, a, np.stack((fast, slow)))[:, 100:-100]
    assert np.abs(out[0] - fast[100:-100]).max() < 0.01 and np.abs(out[1]).max() < 0.01


def test_projection_nmf_peaks_colours():
    x = np.eye(3) * [[3], [2], [1]]
    # scaled by their absolute sums, all rows are wholly outside an empty span; the longest are the axes, the first is picked
    assert lowrank.successive_projection(np.vstack((x, x[:1] + x[1:2])), 0.1) == [0, 1, 2]
    # as they are, the longest is picked first; what its span leaves of the others decides: row 1 and 2 whole, row 0 in part
    assert lowrank.successive_projection(np.vstack((x, x[:1] + x[1:2])), 0.9, scaled=False) == [3, 2]
    assert lowrank.successive_projection(np.array([[1.0, 0, 0], [1, 0.01, 0], [0, 0, 5]]), 0.5) == [0, 2]
    a, c = lowrank.rank1_nmf(np.outer([1, 2, 0], [1, 0, 3]), np.array([True, True, False]))
    assert np.allclose(np.outer(a, c), np.outer([1, 2, 0], [1, 0, 3]))
    assert lowrank.find_peaks(np.array([0, 2, 0, 3, 0, 0, 0, 1, 0.0]), 0.5, 3).tolist() == [3, 7]
    assert lowrank.find_peaks(np.array([0, 2, 2, 2, 0, 5, 4.5, 4.8, 0])).tolist() == [2, 5, 7]
    assert lowrank.find_peaks(np.array([0, 2, 2, 2, 0, 5, 4.5, 4.8, 0]), prominence=1.0).tolist() == [2, 5]
    left, trace = lowrank.rank1_of_factors(np.array([[1.0, 0], [2, 1], [0, 1]]), np.array([[1.0, 0, 3], [2, 0, 6]]))
    assert np.allclose(np.outer(left, trace), np.array([[1.0, 0], [2, 1], [0, 1]]) @ np.array([[1.0, 0, 3], [2, 0, 6]]))
    colour = greedy_colours([(0, 1), (1, 2)], [0, 1, 2])
    assert colour[0] != colour[1] != colour[2]


def test_failures_in_a_row(spark):
    ok = [True, False, True, False, False, True]
    assert lowrank.kept_until(np.array(ok), 2) == 5
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(ok)], "block int, comp int, ok boolean")
    assert pixel.failure_cut(df, 2).count() == 5


def test_compression_rebuilds_a_movie(spark):
    # two sources: a single one is flat once standardised, and flat components are dropped by rule
    x = (np.outer(smooth(12).ravel(), np.sin(np.arange(40) / 4)) + np.outer(smooth(12, 1).ravel(), np.cos(np.arange(40) / 7))).reshape(12, 12, 40)
    rows = [(t, y, c, float(x[y, c, t])) for t in range(40) for y in range(12) for c in range(12)]
    movie = spark.createDataFrame(rows, "frame long, y int, x int, v double")
    u, v = movies.factors_of(movies.compress(movie, 12, 12, (6, 6), 2))
    from framelake.operators.factors import product

    got = np.zeros((144, 40))
    for r in product(u, v).collect():
        got[r["pixel"], r["frame"]] = r["value"]
    want = x.reshape(144, 40) - x.reshape(144, 40).mean(axis=1, keepdims=True)
    assert np.abs(got - want).max() < 1e-8


def test_rigid_registration_plan(spark):
    t = smooth(16)
    frames = spark.createDataFrame([(i, 16, 16, images.shift_frame(t, dy, 0.0).ravel().tolist()) for i, dy in enumerate((0.0, 1.0, -2.0))], movies.FRAME)
    got = {r["frame"]: r["dy"] for r in movies.register_rigid(frames, t, (3, 3)).collect()}
    assert all(abs(got[i] + dy) < 0.01 for i, dy in enumerate((0.0, 1.0, -2.0)))


def test_windows_reach_the_end(spark):
    """Over whole traces, the last window ends at the last frame, also where the stride does not divide."""
    for n, want in ((110, [0, 20, 40, 60, 70]), (100, [0, 20, 40, 60]), (30, [0])):
        traces = spark.createDataFrame([(1, list(range(n)))], "comp int, trace array<int>")
        got = sorted((r["start"], r["snippet"]) for r in factors.snippets(traces, None, 40, 20).collect())
        assert got == [(s, list(range(s, min(s + 40, n)))) for s in want]


def test_network_does_not_see_its_own_frame():
    net = denoise.new_network(3)
    x = np.random.default_rng(0).normal(size=(2, 40))
    mu, var = denoise.predicted(net, x)
    y = x.copy()
    y[0, 17] += 5
    nu, _ = denoise.predicted(net, y)
    assert mu.shape == var.shape == x.shape and (var > 0).all()
    assert np.isclose(nu[0, 17], mu[0, 17]) and not np.allclose(nu[0, 12:22], mu[0, 12:22]) and np.allclose(nu[1], mu[1])


def test_denoiser_keeps_the_data_without_noise_and_trusts_the_network_with_all_of_it():
    net, x = denoise.new_network(1), np.random.default_rng(1).normal(size=(3, 130))
    assert np.allclose(denoise.denoised(net, x, 0.0), x)
    length = np.linalg.norm(x - x.mean(axis=1, keepdims=True), axis=1, keepdims=True)
    mu = denoise.predicted(net, (x - x.mean(axis=1, keepdims=True)) / length)[0]
    assert np.allclose(denoise.denoised(net, x, 1.0, 900), mu * length + x.mean(axis=1, keepdims=True))
    assert denoise.TraceDenoiser(net)(x).shape == x.shape
    assert denoise.windows(100, 40, 20) == [0, 20, 40, 60] and denoise.windows(30, 40, 20) == [0]


def test_convolution_matches_numpy():
    x, w = np.random.default_rng(2).normal(size=(1, 1, 30)), np.random.default_rng(3).normal(size=(1, 1, 3))
    assert np.allclose(denoise.convolved(x, w, np.zeros(1))[0, 0], np.convolve(x[0, 0], w[0, 0, ::-1], "same"))


def test_patches_and_fields():
    starts, size = images.patch_grid(32, 3, 5)
    assert starts == [0, 9, 18] and starts[-1] + size == 32
    frame = smooth(32)
    parts = images.patches(frame, starts, starts, (size, size))
    assert np.allclose(images.scattered(parts, starts, starts, frame.shape) / images.scattered(np.ones_like(parts), starts, starts, frame.shape), frame)
    assert images.patch_centres(starts, starts, (size, size))[1, 2].tolist() == [9 + (size - 1) / 2, 18 + (size - 1) / 2]
    field = np.full((3, 3, 2), (1.0, -2.0))
    for cubic in (False, True):
        assert np.allclose(images.upsampled_field(field, (32, 32), cubic), (1.0, -2.0))
        assert np.allclose(images.warped(frame, np.full((32, 32, 2), (1.0, -2.0)), cubic)[1:, :-2], frame[:-1, 2:])
    y, x = np.mgrid[3:20:0.5, 3:20:0.5]
    line = np.add.outer(np.arange(32.0), 2 * np.arange(32.0))
    assert np.allclose(images.bicubic(line, y, x), y + 2 * x)
    with pytest.raises(ValueError):
        images.patch_grid(10, 3, 6)


def test_gradients_explain_a_small_shift():
    f = smooth(24)
    basis = images.gradients(f)
    assert np.abs(f.ravel() @ basis).max() < 1e-9
    moved = images.shift_frame(f, 0.0, 0.2)
    left = moved.ravel() - basis @ (np.linalg.pinv(basis) @ moved.ravel())
    assert np.abs(left.reshape(f.shape) - f)[3:-3, 3:-3].max() < 0.3 * np.abs(moved - f)[3:-3, 3:-3].max()


def test_spikes_lost_by_smoothing():
    rng, t = np.random.default_rng(5), np.arange(4000)
    clean = np.zeros(4000)
    clean[100::200] = 10
    raw = -(clean + np.sin(t / 500) + rng.normal(0, 0.2, 4000))
    out = lowrank.spike_attenuation(raw, 0.6 * clean + np.sin(t / 500), clean + rng.normal(0, 0.05, 4000), 800.0)
    assert set(out["peaks"]) >= set(range(300, 3700, 200)) and abs(np.median(out["share"]) - 0.4) < 0.05
    assert 0.02 < lowrank.shot_noise_variance(rng.normal(0, 0.2, 20_000), 800.0) < 0.08
