"""Strategies of motion correction and compression: what to do, apart from the movie it is done to."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.kernels import images
from framelake.kernels.denoise import TraceDenoiser
from framelake.plans import movies


def chunks(n_frames: int, size: int) -> list[tuple[int, int]]:
    """Runs of frames; the last one is moved back to be as long as the others."""
    starts = list(range(0, n_frames, size))
    if starts and starts[-1] > n_frames - size and starts[-1] > 0:
        starts[-1] = n_frames - size
    return [(a, min(n_frames, a + size)) for a in starts]


@dataclass(frozen=True)
class Identity:
    """Leaves frames as they are, with shifts of zero."""

    def correct(self, frames: DataFrame, target: DataFrame | None = None) -> DataFrame:
        own = target if target is not None else frames
        return own.select("frame", "h", "w", "data", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))


@dataclass(frozen=True)
class Rigid:
    """One shift for each frame. correct gives frames (of a target movie, if there is one) with dy and dx."""

    template: np.ndarray | None = None
    max_shifts: tuple[int, int] = (15, 15)

    def correct(self, frames: DataFrame, target: DataFrame | None = None) -> DataFrame:
        if self.template is None:
            raise ValueError("a template is needed first")
        if target is None:
            return movies.register_rigid(frames, self.template, self.max_shifts)
        template, most = self.template, self.max_shifts

        def one(frame, other):
            dy, dx = images.estimate_shift(frame, template, most)
            return images.fill_borders(images.shift_frame(other, dy, dx), dy, dx), dy, dx

        return movies.mapped_pairs(frames, target, one, movies.FRAME + ", dy double, dx double")

    def fitted(self, frames: DataFrame, splits: int = 10, size: int = 200, passes: int = 3, seed: int = 0) -> Rigid:
        """With a template: the median of the first frames, then of the means of corrected chunks."""
        return replace(self, template=fitted_template(self, frames, splits, size, passes, seed))


@dataclass(frozen=True)
class Piecewise:
    """A field of shifts for each frame, from a grid of patches near the rigid shift; `field` is dy, dx by rows of patches."""

    template: np.ndarray | None = None
    blocks: tuple[int, int] = (12, 12)
    overlap: tuple[int, int] = (5, 5)
    max_shifts: tuple[int, int] = (15, 15)
    deviation: tuple[int, int] = (2, 2)

    def correct(self, frames: DataFrame, target: DataFrame | None = None) -> DataFrame:
        if self.template is None:
            raise ValueError("a template is needed first")
        template, how = self.template, (self.blocks, self.overlap, self.max_shifts, self.deviation)

        def one(frame, other=None):
            moved, field = images.register_patches(frame, template, *how, target=other)
            return moved, field.ravel().tolist()

        schema = movies.FRAME + ", field array<double>"
        return movies.mapped(frames, one, schema) if target is None else movies.mapped_pairs(frames, target, one, schema)

    def fitted(self, frames: DataFrame, splits: int = 10, size: int = 200, passes: int = 3, seed: int = 0) -> Piecewise:
        """With a template that begins as the rigid one."""
        first = self.template if self.template is not None else Rigid(max_shifts=self.max_shifts).fitted(frames, splits, size, passes, seed).template
        return replace(self, template=fitted_template(replace(self, template=first), frames, splits, size, passes, seed))


@dataclass(frozen=True)
class Gradient:
    """Takes out of each frame what the gradients of the mean image explain; dy and dx are their coefficients."""

    template: np.ndarray | None = None

    def fitted(self, frames: DataFrame) -> Gradient:
        return replace(self, template=movies.mean_frame(frames))

    def correct(self, frames: DataFrame, target: DataFrame | None = None) -> DataFrame:
        if self.template is None:
            raise ValueError("a template is needed first")
        basis = images.gradients(self.template)
        project = np.linalg.pinv(basis)

        def one(frame, other=None):
            sx, sy = project @ frame.ravel()
            own = frame if other is None else other
            return own - (basis @ (sx, sy)).reshape(own.shape), float(sy), float(sx)

        schema = movies.FRAME + ", dy double, dx double"
        return movies.mapped(frames, one, schema) if target is None else movies.mapped_pairs(frames, target, one, schema)


def fitted_template(strategy, frames: DataFrame, splits: int, size: int, passes: int, seed: int) -> np.ndarray:
    """Passes of: correct some chunks, chosen by the seed, and take the median of their means. One image is held."""
    if passes < 1:
        raise ValueError("at least one pass is needed")
    n = (frames.agg(F.max("frame")).first()[0] or 0) + 1
    template = strategy.template if strategy.template is not None else movies.template_of(frames, passes=0)
    runs = chunks(n, size)
    for p in range(passes):
        rng = np.random.default_rng([seed, p])
        use = [runs[i] for i in sorted(rng.choice(len(runs), min(splits, len(runs)), replace=False).tolist())]
        own = frames.where(F.lit(False))
        for k, (a, b) in enumerate(use):
            part = frames.where(F.col("frame").between(a, b - 1))
            own = part.withColumn("run", F.lit(k)) if k == 0 else own.unionByName(part.withColumn("run", F.lit(k)))
        # chunks may share frames, so the corrected ones meet their runs again
        moved = replace(strategy, template=template).correct(own.select("frame", "h", "w", "data").dropDuplicates(["frame"]))
        of = own.select("frame", "run")
        means = moved.join(of, "frame").select("run", F.posexplode("data").alias("p", "v")).groupBy("run", "p").agg(F.avg("v").alias("v"))
        rows = means.groupBy("p").agg(F.median("v").alias("v")).collect()
        template = np.array([v for _, v in sorted((r["p"], r["v"]) for r in rows)]).reshape(template.shape)
    return template


@dataclass(frozen=True)
class Compressed:
    """A factored movie: u (pixel, comp, value), v (comp, frame, value) and the image (pixel, mean, std) that undoes the scaling."""

    u: DataFrame
    v: DataFrame
    image: DataFrame
    height: int
    width: int

    def movie(self, rescale: bool = True) -> DataFrame:
        from framelake.operators import factors

        product = factors.product(self.u, self.v)
        return movies.rescaled(product, self.image) if rescale else product


@dataclass(frozen=True)
class Compress:
    """Block compression: thresholds calibrated on noise, blocks decomposed, blended, and regressed over all frames."""

    block: tuple[int, int] = (32, 32)
    rank: int = 20
    failures: int = 1
    percentile: float = 5.0
    runs: int = 250
    space: int = 1
    time: int = 1
    fit_frames: int | None = None
    seed: int = 0
    denoiser: object = None

    def compress(self, movie: DataFrame, height: int, width: int, n_frames: int) -> Compressed:
        from framelake.operators import graph, pixel

        if min(height, width) < 4 or min(self.block) < 4:
            raise ValueError("blocks and the field of view need 4 pixels a side")
        image = pixel.noise_image(movie).select((F.col("y") * width + F.col("x")).cast("long").alias("pixel"), "y", "x", "mean", "std")
        image = graph.checkpointed(image)
        scaled = movie.join(image, ["y", "x"]).select("frame", "y", "x", ((F.col("v") - F.col("mean")) / F.col("std")).alias("v"))
        part = movies.sampled_frames(scaled, n_frames, self.fit_frames, seed=self.seed) if self.fit_frames else None
        shape = (min(self.block[0], height), min(self.block[1], width))
        cutoffs = movies.thresholds(movie.sparkSession, shape, min(n_frames, self.fit_frames or n_frames), 1, self.runs, self.percentile, self.seed)
        made = graph.checkpointed(movies.compress(scaled, height, width, self.block, self.rank, self.failures, cutoffs, self.seed, self.denoiser, self.space, self.time, part))
        u, v = movies.factors_of(made)
        u = graph.checkpointed(u)
        if part is not None:
            flat = scaled.select((F.col("y") * width + F.col("x")).cast("long").alias("pixel"), "frame", "v")
            basis = made.select("comp", F.explode(F.arrays_zip("pixels", "basis")).alias("z")).select(F.col("z.pixels").alias("pixel"), "comp", F.col("z.basis").alias("value"))
            v = movies.regressed(basis, flat)
        return Compressed(u, graph.checkpointed(v), image.select("pixel", "mean", "std"), height, width)


@dataclass(frozen=True)
class CompressDenoise:
    """Compression, a denoiser fitted to its traces, and compression again with the denoiser.

    fit: traces (k, frames) to a callable; without it a network's weights are given, as training one is up to the caller.
    """

    first: Compress = Compress()
    network: dict | None = None
    fit: object = None
    quantile: float = 1.0
    most_traces: int = 2_000

    def compress(self, movie: DataFrame, height: int, width: int, n_frames: int) -> Compressed:
        if self.fit is None and self.network is None:
            raise ValueError("a network or a way to fit a denoiser is needed")
        denoiser = TraceDenoiser(self.network, self.quantile) if self.network is not None else None
        if denoiser is None:
            made = self.first.compress(movie, height, width, n_frames)
            # a bounded number of traces, those of the smallest hash
            some = made.v.select("comp").distinct().orderBy(F.xxhash64("comp"), "comp").limit(self.most_traces)
            rows = made.v.join(some, "comp").groupBy("comp").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("t")).select(F.col("t.value").alias("t")).collect()
            denoiser = self.fit(np.array([r["t"] for r in rows]))
        return replace(self.first, denoiser=denoiser).compress(movie, height, width, n_frames)
