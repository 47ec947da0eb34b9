"""A blind-spot network on traces in NumPy: what a frame should be, and how sure that is, from the frames around it.

Five plain convolutions feed six masked ones, whose middle tap is zero, of growing dilation, so that no output sees its
own input. A network is a dict of arrays: for each of the two halves (mean, var) the weights `plain`, `masked` (out,
in, 3) with biases, and `final` (outputs of all masked ones to one number).
"""

from __future__ import annotations

import numpy as np

PLAIN = (1, 16, 32, 48, 64, 80)
MASKED = (16, 32, 48, 64, 80, 96)
SLOPE = 0.1


def convolved(x: np.ndarray, w: np.ndarray, bias: np.ndarray, dilation: int = 1) -> np.ndarray:
    """x (n, in, t) with w (out, in, k), zeros beyond the ends, of the same length."""
    k = w.shape[2]
    pad = dilation * (k - 1) // 2
    wide = np.pad(x, ((0, 0), (0, 0), (pad, dilation * (k - 1) - pad)))
    return sum(np.einsum("oi,nit->not", w[:, :, j], wide[:, :, j * dilation : j * dilation + x.shape[2]]) for j in range(k)) + bias[None, :, None]


def masked(w: np.ndarray) -> np.ndarray:
    """The weights with their middle tap set to zero."""
    out = w.copy()
    out[:, :, w.shape[2] // 2] = 0
    return out


def leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, SLOPE * x)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def new_network(seed: int = 0) -> dict:
    """Random weights, scaled by the number of inputs."""
    rng = np.random.default_rng(seed)
    draw = lambda out, inputs, k: rng.uniform(-1, 1, (out, inputs, k)) / np.sqrt(inputs * k)

    def half():
        plain = [(draw(b, a, 3), np.zeros(b)) for a, b in zip(PLAIN[:-1], PLAIN[1:], strict=True)]
        spots = [(draw(b, a, 3), np.zeros(b)) for a, b in zip(PLAIN, MASKED, strict=True)]
        return {"plain": plain, "masked": spots, "final": (draw(1, sum(MASKED), 1), np.zeros(1))}

    return {"mean": half(), "var": half()}


def backbone(half: dict, x: np.ndarray) -> np.ndarray:
    """One number a frame (n, t) from traces (n, t)."""
    layers = [x[:, None, :]]
    for w, b in half["plain"]:
        layers.append(leaky(convolved(layers[-1], w, b)))
    seen = [leaky(convolved(h, masked(w), b, i + 1)) for i, (h, (w, b)) in enumerate(zip(layers, half["masked"], strict=True))]
    return convolved(np.concatenate(seen, axis=1), *half["final"])[:, 0]


def predicted(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and total variance of each frame."""
    return backbone(net["mean"], x), softplus(backbone(net["var"], x))


def windows(n: int, size: int, overlap: int) -> list[int]:
    """Starts of overlapping windows; the last is anchored to the end."""
    size = min(size, n)
    step = max(1, size - overlap)
    return sorted({*range(0, n - size + 1, step), n - size})


def denoised(net: dict, traces: np.ndarray, quantile: float = 0.05, size: int = 900, overlap: int = 200) -> np.ndarray:
    """Posterior means of traces (n, t): predictions where the total variance is all noise, the data where it is not.

    Rows are centred and scaled to length 1. The noise is a quantile of the predicted variance (0: none).
    """
    mean = traces.mean(axis=1, keepdims=True)
    length = np.linalg.norm(traces - mean, axis=1, keepdims=True)
    length[length == 0] = 1
    x = (traces - mean) / length
    noise = np.quantile(predicted(net, x)[1], quantile, axis=1, keepdims=True) if quantile else np.zeros((len(x), 1))
    total, times = np.zeros_like(x), np.zeros(x.shape[1])
    size = min(size, x.shape[1])
    for a in windows(x.shape[1], size, overlap):
        own = x[:, a : a + size]
        mu, var = predicted(net, own)
        most = np.maximum(var, noise)
        w = np.divide(noise, most, out=np.zeros_like(most), where=most > 0)
        total[:, a : a + size] += w * mu + (1 - w) * own
        times[a : a + size] += 1
    return total / times * length + mean


class TraceDenoiser:
    """A callable for `compress`: traces (k, frames) to the same shape, their ends reflected first."""

    def __init__(self, net: dict, quantile: float = 1.0, padding: int = 100):
        self.net, self.quantile, self.padding = net, quantile, padding

    def __call__(self, traces: np.ndarray) -> np.ndarray:
        p = min(self.padding, traces.shape[1] - 1)
        wide = np.pad(traces, ((0, 0), (p, p)), mode="reflect")
        return denoised(self.net, wide, self.quantile, traces.shape[1])[:, p : wide.shape[1] - p]
