"""Kernels on images and frames in NumPy: filters, shifts, patches."""

from __future__ import annotations

import numpy as np


def gaussian(size: int, sigma: float) -> np.ndarray:
    """A square Gaussian of odd size, summing to 1."""
    r = np.arange(size) - (size - 1) / 2
    g = np.exp(-(r**2) / (2 * sigma**2))
    k = np.outer(g, g)
    return k / k.sum()


def gaussian_highpass(sigma_y: float, sigma_x: float) -> np.ndarray:
    """An impulse less a Gaussian that reaches three sigmas."""
    if sigma_y <= 0 or sigma_x <= 0:
        raise ValueError("sigmas must be positive")
    axes = []
    for s in (sigma_y, sigma_x):
        r = int(3 * s)
        g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * s * s))
        axes.append(g / g.sum())
    k = -np.outer(*axes)
    k[k.shape[0] // 2, k.shape[1] // 2] += 1
    return k


def convolve(frames: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Frames (t, h, w) correlated with an odd kernel, edges reflected."""
    r, c = kernel.shape[0] // 2, kernel.shape[1] // 2
    wide = np.pad(frames, ((0, 0), (r, r), (c, c)), mode="reflect")
    out = np.zeros(frames.shape)
    for i in range(kernel.shape[0]):
        for j in range(kernel.shape[1]):
            out += kernel[i, j] * wide[:, i : i + frames.shape[1], j : j + frames.shape[2]]
    return out


def block_starts(n: int, block: int) -> list[int]:
    """Starts of half-overlapping blocks; the last is anchored to the edge."""
    step = block - -(-block // 2)
    starts = list(range(0, max(1, n - block + 1), max(1, step)))
    return starts if starts[-1] + block >= n else [*starts, n - block]


def pyramid_weights(h: int, w: int) -> np.ndarray:
    """1 at the border, one more with each pixel inwards; for odd sizes too."""
    rows, cols = (np.minimum(np.arange(n), np.arange(n)[::-1]) for n in (h, w))
    return 1.0 + np.minimum(rows[:, None], cols[None, :])


def inpaint(frame: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels filled by repeated means of their eight neighbours; the others stay."""
    out = np.where(mask, 0.0, frame)
    seen, rounds = ~mask, 0
    while not seen.all() and seen.any():
        p = np.pad(seen, 1)
        seen = seen | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
        rounds += 1
    for _ in range(rounds):
        p = np.pad(out, 1)
        total = sum(p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
        out = np.where(mask, total / 8, frame)
    return out


def shift_frame(frame: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """A frame moved by a fraction of a pixel with a phase ramp; it wraps around."""
    fy, fx = np.fft.fftfreq(frame.shape[0])[:, None], np.fft.fftfreq(frame.shape[1])[None, :]
    return np.fft.ifft2(np.fft.fft2(frame) * np.exp(-2j * np.pi * (fy * dy + fx * dx))).real


def fill_borders(frame: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """Rows and columns that a shift wrapped around get the nearest valid ones."""
    out = frame.copy()
    for axis, s in ((0, dy), (1, dx)):
        n, view = out.shape[axis], np.moveaxis(out, axis, 0)
        k = min(n - 1, int(np.ceil(abs(s))))
        if s > 0 and k:
            view[:k] = view[k]
        elif s < 0 and k:
            view[n - k :] = view[n - k - 1]
    return out


def estimate_shift(frame: np.ndarray, template: np.ndarray, max_shifts: tuple[int, int], steps: tuple[float, ...] = (0.1, 0.01, 0.001)) -> tuple[float, float]:
    """The shift that moves the frame onto the template: whole pixels by cross-correlation, then ever finer grids."""
    h, w = frame.shape
    cross = np.fft.fft2(template) * np.conj(np.fft.fft2(frame))
    corr = np.fft.ifft2(cross).real
    sy, sx = np.fft.fftfreq(h, 1 / h).round().astype(int), np.fft.fftfreq(w, 1 / w).round().astype(int)
    allowed = (np.abs(sy)[:, None] <= max_shifts[0]) & (np.abs(sx)[None, :] <= max_shifts[1])
    i, j = np.unravel_index(np.argmax(np.where(allowed, corr, -np.inf)), corr.shape)
    best = np.array([sy[i], sx[j]], float)
    fy, fx = np.fft.fftfreq(h), np.fft.fftfreq(w)
    for step in steps:
        grid = np.arange(-10, 11) * step
        ys, xs = best[0] + grid, best[1] + grid
        value = (np.exp(2j * np.pi * np.outer(ys, fy)) @ cross @ np.exp(2j * np.pi * np.outer(fx, xs))).real
        a, b = np.unravel_index(np.argmax(value), value.shape)
        best = np.array([ys[a], xs[b]])
    return float(np.clip(best[0], -max_shifts[0], max_shifts[0])), float(np.clip(best[1], -max_shifts[1], max_shifts[1]))


def register_frame(frame: np.ndarray, template: np.ndarray, max_shifts: tuple[int, int]) -> tuple[np.ndarray, float, float]:
    dy, dx = estimate_shift(frame, template, max_shifts)
    return fill_borders(shift_frame(frame, dy, dx), dy, dx), dy, dx


def bilinear(image: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Values at fractional places, which are held to the border."""
    ys, xs = np.clip(ys, 0, image.shape[0] - 1), np.clip(xs, 0, image.shape[1] - 1)
    y0, x0 = np.minimum(ys.astype(int), max(0, image.shape[0] - 2)), np.minimum(xs.astype(int), max(0, image.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    ty, tx = ys - y0, xs - x0
    top = image[y0, x0] * (1 - tx) + image[y0, x1] * tx
    return top * (1 - ty) + (image[y1, x0] * (1 - tx) + image[y1, x1] * tx) * ty


def register_piecewise(frame: np.ndarray, template: np.ndarray, size: tuple[int, int], max_shifts: tuple[int, int], deviation: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Patches registered within `deviation` of the rigid shift; their shifts, made smooth, warp the frame."""
    dy, dx = estimate_shift(frame, template, max_shifts)
    ys, xs = block_starts(frame.shape[0], size[0]), block_starts(frame.shape[1], size[1])
    moved = shift_frame(frame, dy, dx)
    field = np.zeros((len(ys), len(xs), 2))
    for i, y in enumerate(ys):
        for j, x in enumerate(xs):
            own = np.s_[y : y + size[0], x : x + size[1]]
            field[i, j] = np.array([dy, dx]) + estimate_shift(moved[own], template[own], deviation)
    cy, cx = np.array(ys) + (size[0] - 1) / 2, np.array(xs) + (size[1] - 1) / 2
    gy = np.interp(np.arange(frame.shape[0]), cy, np.arange(len(ys)))
    gx = np.interp(np.arange(frame.shape[1]), cx, np.arange(len(xs)))
    gy, gx = np.meshgrid(gy, gx, indexing="ij")
    my, mx = bilinear(field[..., 0], gy, gx), bilinear(field[..., 1], gy, gx)
    py, px = np.meshgrid(np.arange(frame.shape[0]), np.arange(frame.shape[1]), indexing="ij")
    return bilinear(frame, py - my, px - mx), field


def patch_grid(n: int, blocks: int, overlap: int) -> tuple[list[int], int]:
    """Starts of overlapping patches along an axis, and their length: evenly spread, each `overlap` longer than its stride."""
    if n < overlap or -(-(n - overlap) // blocks) < overlap:
        raise ValueError("patches overlap more than they are apart")
    starts = [int(i * (n - overlap) / blocks) for i in range(blocks)]
    return starts, n - overlap - starts[-1] + overlap


def patches(frame: np.ndarray, ys: list[int], xs: list[int], size: tuple[int, int]) -> np.ndarray:
    """Overlapping patches (rows, columns, h, w) of a frame."""
    return np.lib.stride_tricks.sliding_window_view(frame, size)[np.ix_(ys, xs)]


def scattered(parts: np.ndarray, ys: list[int], xs: list[int], shape: tuple[int, int]) -> np.ndarray:
    """Patches (rows, columns, h, w) added up where they lie in a frame."""
    out = np.zeros(shape)
    for i, y in enumerate(ys):
        for j, x in enumerate(xs):
            out[y : y + parts.shape[2], x : x + parts.shape[3]] += parts[i, j]
    return out


def patch_centres(ys: list[int], xs: list[int], size: tuple[int, int]) -> np.ndarray:
    """Middles (rows, columns, 2) of patches."""
    return np.stack(np.meshgrid(np.array(ys) + (size[0] - 1) / 2, np.array(xs) + (size[1] - 1) / 2, indexing="ij"), axis=-1)


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    """Weights of the four neighbours of a place t between the middle two."""
    far, near = lambda d: a * (d**3 - 5 * d**2 + 8 * d - 4), lambda d: (a + 2) * d**3 - (a + 3) * d**2 + 1
    return np.stack((far(1 + t), near(t), near(1 - t), far(2 - t)))


def bicubic(image: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Values at fractional places by cubic convolution; places and neighbours are held to the border."""
    ys, xs = np.clip(ys, 0, image.shape[0] - 1), np.clip(xs, 0, image.shape[1] - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    wy, wx = _cubic(ys - y0), _cubic(xs - x0)
    out = np.zeros(np.shape(ys))
    for i in range(4):
        for j in range(4):
            out += wy[i] * wx[j] * image[np.clip(y0 + i - 1, 0, image.shape[0] - 1), np.clip(x0 + j - 1, 0, image.shape[1] - 1)]
    return out


def upsampled_field(field: np.ndarray, shape: tuple[int, int], cubic: bool = False) -> np.ndarray:
    """A coarse field (rows, columns, 2) at every pixel, corners on corners."""
    at = lambda n, k: np.linspace(0, k - 1, n) if k > 1 else np.zeros(n)
    gy, gx = np.meshgrid(at(shape[0], field.shape[0]), at(shape[1], field.shape[1]), indexing="ij")
    sample = bicubic if cubic else bilinear
    return np.stack([sample(field[..., k], gy, gx) for k in range(2)], axis=-1)


def warped(frame: np.ndarray, field: np.ndarray, cubic: bool = False) -> np.ndarray:
    """A frame moved by a field of shifts (h, w, 2); places beyond the border take its values."""
    py, px = np.meshgrid(np.arange(frame.shape[0]), np.arange(frame.shape[1]), indexing="ij")
    return (bicubic if cubic else bilinear)(frame, py - field[..., 0], px - field[..., 1])


def register_patches(frame: np.ndarray, template: np.ndarray, blocks: tuple[int, int], overlap: tuple[int, int], max_shifts: tuple[int, int], deviation: tuple[int, int], target: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A grid of patches registered within `deviation` of the rigid shift; their field, upsampled, warps the frame (or a target)."""
    dy, dx = estimate_shift(frame, template, max_shifts)
    moved = shift_frame(frame, dy, dx)
    (ys, h), (xs, w) = patch_grid(frame.shape[0], blocks[0], overlap[0]), patch_grid(frame.shape[1], blocks[1], overlap[1])
    own, theirs = patches(moved, ys, xs, (h, w)), patches(template, ys, xs, (h, w))
    field = np.array([[(dy, dx) + np.array(estimate_shift(own[i, j], theirs[i, j], deviation)) for j in range(len(xs))] for i in range(len(ys))])
    return warped(frame if target is None else target, upsampled_field(field, frame.shape)), field


def gradients(image: np.ndarray) -> np.ndarray:
    """Central differences of an image along x and y (pixels, 2), zero at the edges, each made orthogonal to the image."""
    gx, gy = np.zeros(image.shape), np.zeros(image.shape)
    gx[:, 1:-1], gy[1:-1] = (image[:, 2:] - image[:, :-2]) / 2, (image[2:] - image[:-2]) / 2
    f = image.ravel()
    both = np.stack((gx.ravel(), gy.ravel()), axis=1)
    return both - np.outer(f, f @ both / (f @ f))
