"""Background, residual correlations and the steps of the demixing loop that use them.

Tables as in `factors`: u, a (pixel, comp, value), v, c (comp, frame, value). A background is a pair: mix (pixel, r,
value) and course (r, frame, value).
"""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import factors, pixel


class Mode(Enum):
    """Which residual correlations to show: all, those off a footprint's support, or with the signal left out."""

    DEFAULT = "default"
    MASKED = "masked"
    RESIDUAL = "residual"


def background_movie(mix: DataFrame, course: DataFrame) -> DataFrame:
    """pixel, frame, value."""
    return factors.product(mix.withColumnRenamed("r", "comp"), course.withColumnRenamed("r", "comp"))


def baseline(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame, mix: DataFrame, course: DataFrame) -> DataFrame:
    """pixel, b: mean of U V less A C and less the background."""
    bg = factors.mean_product(mix.withColumnRenamed("r", "comp"), course.withColumnRenamed("r", "comp")).select("pixel", (-F.col("mean")).alias("b"))
    return factors.baseline(u, v, a, c).union(bg).groupBy("pixel").agg(F.sum("b").alias("b"))


def ring_weights(x: DataFrame, radius: int, width: int) -> DataFrame:
    """pixel, weight: least squares of each pixel of x (pixel, r, value) on the sum over its ring, over all r."""
    flat = x.select("r", F.expr(f"CAST(pixel div {width} AS INT)").alias("y"), F.expr(f"CAST(pixel % {width} AS INT)").alias("x"), "value")
    rings = ring_of(flat, radius)
    both = flat.join(rings, ["r", "y", "x"]).groupBy("y", "x").agg(F.sum(F.col("ring") * F.col("value")).alias("top"), F.sum(F.col("ring") * F.col("ring")).alias("low"))
    return both.select((F.col("y") * width + F.col("x")).cast("long").alias("pixel"), F.when(F.col("low") == 0, 0.0).otherwise(F.col("top") / F.col("low")).alias("weight"))


def ring_of(flat: DataFrame, radius: int) -> DataFrame:
    """r, y, x, ring: sums over rings, of several images (r, y, x, value) at once; zero beyond the edges."""
    reach = radius + 1
    ring = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if radius - 0.5 <= (dy * dy + dx * dx) ** 0.5 <= radius + 0.5]
    sums = pixel.at_offsets(flat, ring).groupBy("r", "y", "x").agg(F.sum("value").alias("ring"))
    return flat.select("r", "y", "x").join(sums, ["r", "y", "x"], "left").select("r", "y", "x", F.coalesce("ring", F.lit(0.0)).alias("ring"))


def _centred(c: DataFrame) -> DataFrame:
    return c.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("comp")))


def residual_correlation(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame, n_frames: int, noise: float = 0.0, mode: Mode = Mode.DEFAULT) -> DataFrame:
    """pixel, comp, corr of the centred residual U V - A C with each trace; on a footprint its own signal is added back.

    All inner products come from Gram tables of components: with X = U V - A C, X c = U (V c) - A (C c), and the norm
    of X + a_k c_k at a pixel is |X|^2 + 2 a_k X c_k + a_k^2 |c_k|^2. MASKED leaves supports out; RESIDUAL adds nothing.
    """
    vz, cz = _centred(v), _centred(c)
    u_part = u.select("pixel", F.concat(F.lit("u"), "comp").alias("comp"), "value")
    a_part = a.select("pixel", F.concat(F.lit("a"), "comp").alias("comp"), (-F.col("value")).alias("value"))
    left = u_part.unionByName(a_part)
    right = vz.select(F.concat(F.lit("u"), "comp").alias("comp"), "frame", "value").unionByName(cz.select(F.concat(F.lit("a"), "comp").alias("comp"), "frame", "value"))
    pairs = left.select("pixel", F.col("comp").alias("ka"), F.col("value").alias("p")).join(left.select("pixel", F.col("comp").alias("kb"), F.col("value").alias("q")), "pixel")
    # only pairs of components that share a pixel are ever multiplied over the frames
    wanted = pairs.select("ka", "kb").distinct()
    own = right.select("frame", F.col("comp").alias("ka"), F.col("value").alias("x")).join(wanted, "ka").join(right.select("frame", F.col("comp").alias("kb"), F.col("value").alias("y")), ["kb", "frame"])
    grams = own.groupBy("ka", "kb").agg(F.sum(F.col("x") * F.col("y")).alias("w"))
    norm = pairs.join(grams, ["ka", "kb"]).groupBy("pixel").agg((F.sum(F.col("p") * F.col("q") * F.col("w")) + noise * noise * n_frames).alias("n2"))
    cross = factors.gram(right, cz, "frame").select(F.col("ka").alias("comp"), F.col("kb").alias("k"), F.col("value").alias("w"))
    dots = left.join(cross, "comp").groupBy("pixel", F.col("k").alias("comp")).agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    size = factors.squared_norms(cz)
    rows = dots.join(norm, "pixel").join(size, "comp").join(a.where("value <> 0").select("pixel", "comp", F.col("value").alias("own")), ["pixel", "comp"], "left")
    if mode is Mode.MASKED:
        rows = rows.where("own IS NULL")
    add = F.coalesce("own", F.lit(0.0)) if mode is not Mode.RESIDUAL else F.lit(0.0)
    top, low = F.col("s") + add * F.col("norm2"), F.col("n2") + 2 * add * F.col("s") + add * add * F.col("norm2")
    return rows.select("pixel", "comp", F.when((low < 1e-12) | (F.col("norm2") < 1e-12), 0.0).otherwise(top / F.sqrt(low * F.col("norm2"))).alias("corr"))


def supported(a: DataFrame, corr: DataFrame, threshold: float) -> DataFrame:
    """comp of the components that correlate above the threshold somewhere on their support; none left is an error."""
    kept = a.where("value > 0").join(corr, ["pixel", "comp"]).groupBy("comp").agg(F.max("corr").alias("best")).where(F.col("best") > threshold).select("comp")
    if kept.isEmpty():
        raise ValueError("all components would be deleted")
    return kept


def widened(a: DataFrame, corr: DataFrame, share: float, width: int, steps: int = 30) -> DataFrame:
    """pixel, comp, value: footprints with the pixels that touch them, step by step, and reach a share of their best correlation.

    New pixels have value 0, so that the next update can fill them.
    """
    from framelake.operators import spatial

    at = lambda t: t.select("comp", F.expr(f"CAST(pixel div {width} AS INT)").alias("y"), F.expr(f"CAST(pixel % {width} AS INT)").alias("x"))
    best = a.where("value > 0").join(corr, ["pixel", "comp"]).groupBy("comp").agg((F.max("corr") * share).alias("least"))
    good = corr.join(best, "comp").where(F.col("corr") >= F.col("least"))
    reached = spatial.grown(at(a.where("value > 0")), at(good), steps)
    new = reached.select((F.col("y") * width + F.col("x")).cast("long").alias("pixel"), "comp")
    return new.unionByName(a.where("value > 0").select("pixel", "comp")).distinct().join(a, ["pixel", "comp"], "left").select("pixel", "comp", F.coalesce("value", F.lit(0.0)).alias("value"))


def affine_scale(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame, b: DataFrame, m: DataFrame, nonneg: bool = True) -> DataFrame:
    """comp, m: one step of the scales of given traces, all at once; components that overlap belong in different calls.

    m + (c_k' (A'(U V - b))_k - sum_j (A'A)_kj m_j c_k'c_j) / (|c_k|^2 |a_k|^2).
    """
    au = factors.gram(a, u, "pixel").select(F.col("ka").alias("comp"), F.col("kb").alias("r"), F.col("value").alias("w"))
    cv = factors.gram(c, v, "frame").select(F.col("ka").alias("comp"), F.col("kb").alias("r"), F.col("value").alias("z"))
    data = au.join(cv, ["comp", "r"]).groupBy("comp").agg(F.sum(F.col("w") * F.col("z")).alias("data"))
    ab = a.join(b, "pixel").groupBy("comp").agg(F.sum(F.col("value") * F.col("b")).alias("ab"))
    sums = c.groupBy("comp").agg(F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("c2"))
    aa = factors.gram(a, a, "pixel").withColumnRenamed("value", "w")
    cc = factors.gram(c, c, "frame").withColumnRenamed("value", "z")
    other = aa.join(cc, ["ka", "kb"]).join(m.select(F.col("comp").alias("kb"), "m"), "kb").groupBy(F.col("ka").alias("comp")).agg(F.sum(F.col("w") * F.col("z") * F.col("m")).alias("model"))
    step = (F.col("data") - F.col("ab") * F.col("sum") - F.col("model")) / (F.col("c2") * F.col("norm2"))
    new = m.join(data, "comp").join(ab, "comp").join(sums, "comp").join(other, "comp").join(factors.squared_norms(a), "comp")
    value = F.col("m") + F.coalesce(F.nanvl(step, F.lit(0.0)), F.lit(0.0))
    return new.select("comp", (F.greatest(value, F.lit(0.0)) if nonneg else value).alias("m"))


def affine_baseline(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame, m: DataFrame) -> DataFrame:
    """pixel, b: mean of U V less A (m mean(C))."""
    return factors.baseline(u, v, a, c.join(m, "comp").select("comp", "frame", (F.col("value") * F.col("m")).alias("value")))


def factored_svd(u: DataFrame, v: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Mixing (r x k), singular values and traces' mixing (k x r) of U V, and the components' order, without forming it.

    Only the two Gram tables of components come to the driver: with G = V V' = L L', U V V' U' has the eigenvalues of
    L' U'U L, and the right factor is a mix of V's rows.
    """
    uu, vv = (factors.gram(t, t, axis).toPandas() for t, axis in ((u, "pixel"), (v, "frame")))
    names = sorted(set(vv["ka"]) | set(uu["ka"]))
    nth = {n: i for i, n in enumerate(names)}
    dense = []
    for t in (uu, vv):
        g = np.zeros((len(names), len(names)))
        g[t["ka"].map(nth), t["kb"].map(nth)] = t["value"]
        dense.append((g + g.T) / 2)
    values, vectors = np.linalg.eigh(dense[1])
    good = values > values.max(initial=0) * 1e-12
    root, back = vectors[:, good] * np.sqrt(values[good]), vectors[:, good] / np.sqrt(values[good])
    eig, w = np.linalg.eigh(root.T @ dense[0] @ root)
    keep = eig > eig.max(initial=0) * 1e-12
    eig, w = eig[keep][::-1], w[:, keep][:, ::-1]
    s = np.sqrt(eig)
    return root @ (w / s), s, w.T @ back.T, names
