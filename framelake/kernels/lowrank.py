"""Small matrix kernels in NumPy: sketches, rank choice, projections, traces."""

from __future__ import annotations

import numpy as np


def signed(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each left vector's largest entry made positive, so that results do not depend on the solver."""
    if not u.size:
        return u, v
    s = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    s[s == 0] = 1
    return u * s, v * s[:, None]


def sketch_svd(x: np.ndarray, rank: int, rng: np.random.Generator, extra: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading singular triplets from a Gaussian sketch."""
    k = min(rank + extra, *x.shape)
    q = np.linalg.qr(x @ rng.normal(size=(x.shape[1], k)))[0]
    u, s, v = np.linalg.svd(q.T @ x, full_matrices=False)
    u, v = signed(q @ u[:, :rank], v[:rank])
    return u, s[:rank], v


def trace_roughness(v: np.ndarray) -> np.ndarray:
    """Of each row: mean absolute second difference over mean absolute value."""
    low = np.abs(v).mean(axis=1)
    return np.abs(v[:, 2:] + v[:, :-2] - 2 * v[:, 1:-1]).mean(axis=1) / np.where(low == 0, 1, low)


def image_roughness(images: np.ndarray, both_diagonals: bool = False) -> np.ndarray:
    """Of each image (k, h, w): mean absolute neighbour difference over mean absolute value."""
    down, right = np.abs(np.diff(images, axis=1)), np.abs(np.diff(images, axis=2))
    diag = np.abs(images[:, 1:, 1:] - images[:, :-1, :-1])
    other = np.abs(images[:, 1:, :-1] - images[:, :-1, 1:]) if both_diagonals else diag
    parts = (down, right, diag, other)
    top = sum(p.sum(axis=(1, 2)) for p in parts) / sum(p[0].size for p in parts)
    low = np.abs(images).mean(axis=(1, 2))
    return top / np.where(low == 0, 1, low)


def kept_until(ok: np.ndarray, limit: int) -> int:
    """How many come up to and with the one that makes `limit` failures in a row."""
    run = 0
    for i, good in enumerate(ok):
        run = 0 if good else run + 1
        if run == limit:
            return i + 1
    return len(ok)


def noise_std(x: np.ndarray) -> np.ndarray:
    """Of each row: sqrt(E d^2 - lag-1 covariance); under 1e-8 it is 1."""
    d = x - x.mean(axis=1, keepdims=True)
    var = (d * d).mean(axis=1) - (d[:, 1:] * d[:, :-1]).mean(axis=1) if x.shape[1] > 1 else np.zeros(len(x))
    return np.where(var < 1e-8, 1.0, np.sqrt(np.maximum(var, 0)))


def binned(x: np.ndarray, shape: tuple[int, int], space: int, time: int) -> np.ndarray:
    """Rows (pixels, frames) averaged over space x space pixels, edges dropped, and over time frames, the last bin partial."""
    h, w = shape[0] // space * space, shape[1] // space * space
    x = x.reshape(*shape, -1)[:h, :w].reshape(h // space, space, w // space, space, -1).mean(axis=(1, 3)).reshape(h // space * (w // space), -1)
    if time > 1:
        starts = np.arange(0, x.shape[1], time)
        x = np.add.reduceat(x, starts, axis=1) / np.diff(np.append(starts, x.shape[1]))
    return x


def decompose_block(x: np.ndarray, shape: tuple[int, int], rank: int, thresholds: tuple[float, float] | None, failures: int, rng: np.random.Generator, space: int = 1, time: int = 1, denoise=None, share: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
    """Basis (pixels, k) and traces (k, frames) of one standardised block (pixels, frames).

    A first basis is sought in bins of space and time; its traces over all frames are denoised, if asked for, and cut to
    the principal ones; the block is then regressed on them at full resolution.
    thresholds: the most spatial and temporal roughness of a kept component; None keeps all of them.
    """
    if space > 1 or time > 1 or denoise is not None:
        low, _, _ = sketch_svd(binned(x, shape, space, time), rank, rng)
        courses = low.T @ binned(x, shape, space, 1)
        if denoise is not None and len(courses):
            courses = explained_basis(denoise(courses), share)
        basis, _, _ = np.linalg.svd(x @ np.linalg.qr(courses.T)[0], full_matrices=False)
        w, s, v = np.linalg.svd(basis.T @ x, full_matrices=False)
        u, v = signed((basis @ w)[:, :rank], v[:rank])
        s = s[:rank]
    else:
        u, s, v = sketch_svd(x, rank, rng)
    v = s[:, None] * v
    n = u.shape[1]
    if thresholds is not None and n:
        # counted over all components, flat ones too; those before and with the last failure stay
        n = kept_until((image_roughness(u.T.reshape(-1, *shape)) < thresholds[0]) & (trace_roughness(v) < thresholds[1]), failures)
    alive = (u[:, :n].std(axis=0, ddof=1) > 1e-6) & (v[:n].std(axis=1, ddof=1) > 1e-6)
    return u[:, :n][:, alive], v[:n][alive]


def butterworth_highpass(order: int, cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth high-pass, by the bilinear transform."""
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    poles = warped / np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    z = (2 * rate + poles) / (2 * rate - poles)
    a = np.poly(z).real
    b = np.poly(np.ones(order))
    return b * (np.polyval(a, -1) / np.polyval(b, -1)), a


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rows of x filtered, from the given state (order, rows)."""
    z, out = state.copy(), np.empty_like(x)
    for t in range(x.shape[1]):
        now = x[:, t]
        y = b[0] * now + z[0]
        z[:-1] = z[1:] + np.outer(b[1:-1], now) - np.outer(a[1:-1], y)
        z[-1] = b[-1] * now - a[-1] * y
        out[:, t] = y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows filtered forwards and backwards, ends extended by odd reflection."""
    n = min(3 * max(len(a), len(b)), x.shape[1] - 1)
    wide = np.concatenate((2 * x[:, :1] - x[:, n:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -n - 2 : -1]), axis=1)
    k = len(a) - 1
    companion = np.eye(k) - np.concatenate((-a[1:, None], np.eye(k, k - 1)), axis=1)
    zi = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
    y = lfilter(b, a, wide, np.outer(zi, wide[:, 0]))
    y = lfilter(b, a, y[:, ::-1], np.outer(zi, y[:, -1]))[:, ::-1]
    return y[:, n : n + x.shape[1]]


def successive_projection(traces: np.ndarray, threshold: float, most: int | None = None, scaled: bool = True) -> list[int]:
    """Rows of which most lies outside the span of those picked, relative to their own length, until none exceeds the threshold.

    scaled: rows are first divided by their absolute sum. Of rows as far out, to a millionth, the longest is picked.
    """
    left = np.array(traces, float)
    if scaled:
        left /= np.abs(left).sum(axis=1, keepdims=True)
    whole = (left**2).sum(axis=1)
    now, picked = whole.copy(), []
    while len(picked) < (most or len(left)):
        share = np.divide(now, whole, out=np.zeros_like(now), where=whole > 0)
        if np.sqrt(share.max(initial=0)) <= threshold:
            break
        near = np.flatnonzero(share.max() - share <= 1e-6 * share.max())
        i = int(near[np.argmax(whole[near])])
        picked.append(i)
        w = left[i] / np.linalg.norm(left[i])
        left -= np.outer(left @ w, w)
        now = (left**2).sum(axis=1)
    return picked


def explained_basis(traces: np.ndarray, share: float = 0.99) -> np.ndarray:
    """The principal courses of centred rows, up to the first with which they explain the share of the variance."""
    _, s, right = np.linalg.svd(traces - traces.mean(axis=1, keepdims=True), full_matrices=False)
    total = (s**2).sum()
    reached = np.cumsum(s**2) / total >= share if total else np.zeros(len(s), bool)
    return right[: int(np.argmax(reached)) + 1 if reached.any() else len(traces)]


def rank1_nmf(x: np.ndarray, support: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative a (pixels) on the support and c (frames) with a c' near x."""
    c = np.maximum(x[support].mean(axis=0), 0) if support.any() else np.zeros(x.shape[1])
    a = np.zeros(len(x))
    for _ in range(rounds):
        a[support] = np.maximum(x[support] @ c / max(c @ c, 1e-12), 0)
        c = np.maximum(a @ x / max(a @ a, 1e-12), 0)
    return a, c


def rank1_of_factors(a: np.ndarray, c: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative rank-1 factors of A C (pixels x k, k x frames), from products with A and C alone."""
    trace = np.maximum(c.mean(axis=0), 0)
    left = np.zeros(len(a))
    for _ in range(rounds):
        left = np.maximum(a @ (c @ trace) / max(trace @ trace, 1e-12), 0)
        trace = np.maximum((left @ a) @ c / max(left @ left, 1e-12), 0)
    return left, trace


def find_peaks(x: np.ndarray, height: float = -np.inf, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Middles of flat or sharp local maxima of at least a height; of those nearer than a distance the higher stays.

    A peak's prominence is its height over the higher of the two lowest points on the way to a higher place or an end.
    """
    edge = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(x) - 1]))
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.empty(0, int)
    at = (starts[top] + ends[top]) // 2
    at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    for i in np.argsort(-x[at], kind="stable"):
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep[near] = False
    at = at[keep]
    if prominence > 0:
        at = np.array([i for i in at.tolist() if _prominence(x, i) >= prominence], int)
    return at


def _prominence(x: np.ndarray, i: int) -> float:
    left, right = np.flatnonzero(x[:i] > x[i]), np.flatnonzero(x[i + 1 :] > x[i])
    a, b = (left[-1] + 1 if len(left) else 0), (i + 1 + right[0] if len(right) else len(x))
    return float(x[i] - max(x[a : i + 1].min(), x[i:b].min()))


def shot_noise_variance(trace: np.ndarray, rate: float, cutoff: float = 300.0) -> float:
    """Variance above the cutoff, scaled up to the whole band."""
    if rate / 2 <= cutoff:
        raise ValueError("the cutoff must be below half the rate")
    b, a = butterworth_highpass(5, cutoff, rate)
    return float(np.var(zero_phase(b, a, np.asarray(trace, float)[None])[0]) * (rate / 2) / (rate / 2 - cutoff))


def spike_attenuation(raw: np.ndarray, compressed: np.ndarray, trace: np.ndarray, rate: float, trend: float = 1.0, spike: float = 3.0, mad: float = 8.0, flipped: bool = True) -> dict[str, np.ndarray]:
    """Heights of a trace's spikes in a raw and a compressed average over one region, and how much is lost.

    Heights stand over the low-pass trend; losses below zero count as none.
    """
    raw = raw * (-1.0 if flipped else 1.0)
    raw, compressed = raw - raw.mean() if flipped else raw, compressed - compressed.mean()

    def high(x, cutoff):
        b, a = butterworth_highpass(5, cutoff, rate)
        return zero_phase(b, a, np.asarray(x, float)[None])[0]

    sharp = high(trace, spike)
    centre = np.median(sharp)
    cut = np.maximum(0, sharp - centre - mad * np.median(np.abs(sharp - centre)))
    at = find_peaks(cut, distance=10)
    low, full = high(compressed, trend)[at], high(raw, trend)[at]
    lost = np.maximum(full - low, 0)
    std = np.std(raw - compressed)
    share = np.divide(lost, full, out=np.zeros_like(lost), where=full != 0)
    return {"peaks": at, "compressed": low, "raw": full, "lost": lost, "share": share, "score": lost / std if std else np.zeros_like(lost)}


def low_rank(stack: np.ndarray, rank: int = 25) -> np.ndarray:
    """The nearest matrix of a rank, by singular values."""
    u, s, v = np.linalg.svd(stack, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ v[:rank]
