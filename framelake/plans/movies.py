"""Plans on frames as rows (frame, h, w, data): registration, filters, and block compression."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.kernels import images, lowrank

FRAME = "frame long, h int, w int, data array<double>"


def as_frames(movie: DataFrame, height: int, width: int) -> DataFrame:
    """Frames as rows from a long movie (frame, y, x, v); absent cells are 0. One shuffle by frame."""
    cells = movie.groupBy("frame").agg(F.collect_list((F.col("y") * width + F.col("x")).cast("int")).alias("p"), F.collect_list("v").alias("v"))

    def fill(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, height * width))
            p, v = batch.column("p"), batch.column("v")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(p).to_numpy(zero_copy_only=False))
            out[row, p.flatten().to_numpy()] = v.flatten().to_numpy()
            yield _frames(batch.column("frame"), out.reshape(-1, height, width))

    return cells.mapInArrow(fill, FRAME)


def _frames(numbers, frames: np.ndarray, more: dict | None = None) -> pa.RecordBatch:
    """An Arrow batch of frames of one shape, from their values in one buffer."""
    n, h, w = frames.shape
    data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h * w, pa.int32()), pa.array(np.ascontiguousarray(frames, np.float64).ravel()))
    columns = {"frame": numbers, "h": pa.array([h] * n, pa.int32()), "w": pa.array([w] * n, pa.int32()), "data": data} | (more or {})
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _images(batch: pa.RecordBatch, name: str = "data") -> list[np.ndarray]:
    """The frames of a batch, as views of its buffer."""
    flat, out, at = batch.column(name).flatten().to_numpy().astype(float, copy=False), [], 0
    for h, w in zip(batch.column("h").to_pylist(), batch.column("w").to_pylist(), strict=True):
        out.append(flat[at : at + h * w].reshape(h, w))
        at += h * w
    return out


def mapped(frames: DataFrame, f, schema: str = FRAME) -> DataFrame:
    """f(frame array) of every frame, without a shuffle; f returns an image, or an image and more columns."""
    names = [x.split()[0] for x in schema.split(", ")][4:]

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [f(x) for x in _images(batch)]
            made = [x if isinstance(x, tuple) else (x,) for x in made]
            yield _frames(batch.column("frame"), np.stack([x[0] for x in made]), {n: pa.array([x[i + 1] for x in made]) for i, n in enumerate(names)})

    return frames.mapInArrow(apply, schema)


def mapped_pairs(frames: DataFrame, targets: DataFrame, f, schema: str = FRAME) -> DataFrame:
    """f(frame array, target array) of every frame and the target of the same number; an equi-join by frame."""
    names = [x.split()[0] for x in schema.split(", ")][4:]
    both = frames.select("frame", "h", "w", "data").join(targets.select("frame", F.col("data").alias("target")), "frame")

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [f(x, y) for x, y in zip(_images(batch), _images(batch, "target"), strict=True)]
            yield _frames(batch.column("frame"), np.stack([x[0] for x in made]), {n: pa.array([x[i + 1] for x in made]) for i, n in enumerate(names)})

    return both.mapInArrow(apply, schema)


def register_rigid(frames: DataFrame, template: np.ndarray, max_shifts: tuple[int, int] = (15, 15)) -> DataFrame:
    """Registered frames with their dy and dx; the template (one image) goes with the closure."""
    return mapped(frames, lambda x: images.register_frame(x, template, max_shifts), FRAME + ", dy double, dx double")


def register_piecewise(frames: DataFrame, template: np.ndarray, size: tuple[int, int] = (12, 12), max_shifts: tuple[int, int] = (15, 15), deviation: tuple[int, int] = (2, 2)) -> DataFrame:
    """Registered frames with the shifts of their patches, row by row: dy, dx, dy, dx, ..."""

    def one(x):
        moved, field = images.register_piecewise(x, template, size, max_shifts, deviation)
        return moved, field.ravel().tolist()

    return mapped(frames, one, FRAME + ", field array<double>")


def template_of(frames: DataFrame, first: int = 500, passes: int = 1, chunk: int = 200, chunks: int = 10, max_shifts: tuple[int, int] = (15, 15), seed: int = 0) -> np.ndarray:
    """Median of the first frames, then medians of the means of registered chunks, chosen by a seed."""

    def image(df: DataFrame, how) -> np.ndarray:
        h, w = frames.select("h", "w").first()
        rows = df.select(F.posexplode("data").alias("p", "v")).groupBy("p").agg(how("v").alias("v")).collect()
        out = np.zeros(h * w)
        out[[r["p"] for r in rows]] = [r["v"] for r in rows]
        return out.reshape(h, w)

    template = image(frames.where(F.col("frame") < first), F.median)
    n = frames.agg(F.max("frame")).first()[0] + 1
    starts = sorted({*range(0, max(1, n - chunk + 1), chunk), max(0, n - chunk)})
    for p in range(passes):
        use = sorted(np.random.default_rng(seed + p).choice(starts, min(chunks, len(starts)), replace=False).tolist())
        cut = frames.withColumn("chunk", F.explode(F.array(*map(F.lit, use)))).where(f"frame >= chunk AND frame < chunk + {chunk}")
        moved = register_rigid(cut.select("frame", "h", "w", "data"), template, max_shifts).select("frame", F.posexplode("data").alias("p", "v"))
        member = F.explode(F.array(*map(F.lit, use)))
        means = moved.withColumn("chunk", member).where(f"frame >= chunk AND frame < chunk + {chunk}").groupBy("chunk", "p").agg(F.avg("v").alias("v"))
        rows = means.groupBy("p").agg(F.median("v").alias("v")).collect()
        template = np.array([v for _, v in sorted((r["p"], r["v"]) for r in rows)]).reshape(template.shape)
    return template


def mean_frame(frames: DataFrame) -> np.ndarray:
    """The mean image; partial sums by pixel, one image at the driver."""
    h, w = frames.select("h", "w").first()
    rows = frames.select(F.posexplode("data").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("v")).collect()
    return np.array([v for _, v in sorted((r["p"], r["v"]) for r in rows)]).reshape(h, w)


def spatially_filtered(u: DataFrame, v: DataFrame, image: DataFrame, height: int, width: int, sigma: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """u, new traces and new image (std 1) of a factored movie whose frames are high-passed, cut at 0 and projected back.

    The frames are made, filtered and projected where they are, one at a time; U is one table that every frame meets.
    """
    from framelake.operators import factors

    kernel = images.gaussian_highpass(sigma, sigma)
    full = rescaled(factors.product(u, v), image)
    frames = as_frames(full.select("frame", F.expr(f"CAST(pixel div {width} AS INT)").alias("y"), F.expr(f"CAST(pixel % {width} AS INT)").alias("x"), F.col("value").alias("v")), height, width)
    sharp = mapped(frames, lambda x: np.maximum(images.convolve(x[None], kernel)[0], 0))
    flat = sharp.select("frame", F.posexplode("data").alias("pixel", "v")).select(F.col("pixel").cast("long").alias("pixel"), "frame", "v")
    new = factors.project(u, flat)
    mean = factors.mean_product(u, new)
    return u, new, mean.select("pixel", "mean", F.lit(1.0).alias("std"))


def thresholds(spark, shape: tuple[int, int], n_frames: int, rank: int = 1, runs: int = 250, percentile: float = 5.0, seed: int = 0) -> tuple[float, float]:
    """Roughness that a share of pure noise falls below, in space and in time; each run has its own seed."""

    def run(parts):
        for part in parts:
            rows = []
            for i in part["id"]:
                rng = np.random.default_rng([seed, int(i)])
                x = rng.normal(size=(shape[0] * shape[1], n_frames))
                u, s, v = lowrank.sketch_svd(x, rank, rng)
                rows.append((float(lowrank.image_roughness(u.T.reshape(-1, *shape)).min()), float(lowrank.trace_roughness(v).min())))
            yield pd.DataFrame(rows, columns=["space", "time"])

    noise = spark.range(0, runs, numPartitions=min(runs, spark.sparkContext.defaultParallelism)).mapInPandas(run, "space double, time double")
    return tuple(noise.agg(F.expr(f"percentile(space, {percentile / 100})"), F.expr(f"percentile(time, {percentile / 100})")).first())


def compress(movie: DataFrame, height: int, width: int, block: tuple[int, int] = (32, 32), rank: int = 20, failures: int = 1, cutoffs: tuple[float, float] | None = None, seed: int = 0, denoise=None, space: int = 1, time: int = 1, fit: DataFrame | None = None) -> DataFrame:
    """Block low-rank factors of a long movie: comp, pixels and weights (array), trace (array).

    space, time: bins in which the first basis is sought. fit: a part of the movie (say `sampled_frames`) on which the
    blocks are fitted instead, so that a block's memory does not grow with the recording; `regressed` then gives the
    traces over all frames.

    Pixels meet their blocks by an exploded list of block ids, so the one large shuffle is an equi-grouping by
    block; a block is one NumPy decomposition, seeded by its id. Overlapping blocks are blended by pyramid
    weights, normalised over the blocks that kept a component. denoise: traces (k, frames) to the same shape.
    """
    ys, xs = images.block_starts(height, block[0]), images.block_starts(width, block[1])
    h, w = min(block[0], height), min(block[1], width)
    blocks = [(y, x) for y in ys for x in xs]
    # a pixel's blocks follow from its place: the few starts along each axis that reach it
    holds = lambda axis, starts, n: F.filter(F.transform(F.lit(starts).cast("array<int>"), lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda z: (z["s"] <= F.col(axis)) & (F.col(axis) < z["s"] + n))
    held = (fit if fit is not None else movie).withColumn("by", F.explode(holds("y", ys, h))).withColumn("bx", F.explode(holds("x", xs, w)))
    held = held.select("frame", "y", "x", "v", (F.col("by.i") * len(xs) + F.col("bx.i")).cast("int").alias("block"))
    weights = images.pyramid_weights(h, w).ravel()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        i = int(part["block"].iloc[0])
        y0, x0 = blocks[i]
        frames = np.unique(part["frame"])
        x = np.zeros((h * w, len(frames)))
        x[(part["y"] - y0) * w + part["x"] - x0, np.searchsorted(frames, part["frame"])] = part["v"]
        x = x - x.mean(axis=1, keepdims=True)
        std = lowrank.noise_std(x)
        u, v = lowrank.decompose_block(x / std[:, None], (h, w), rank, cutoffs, failures, np.random.default_rng([seed, i]), space, time, denoise)
        pixels = [((y0 + p // w) * width + x0 + p % w) for p in range(h * w)]
        return pd.DataFrame([(i, k, pixels, (u[:, k] * std).tolist(), weights.tolist(), frames.tolist(), v[k].tolist()) for k in range(u.shape[1])], columns=["block", "k", "pixels", "basis", "weights", "frames", "trace"])

    made = held.groupBy("block").applyInPandas(one, "block int, k int, pixels array<long>, basis array<double>, weights array<double>, frames array<long>, trace array<double>")
    return made.withColumn("comp", F.col("block") * (rank + 1) + F.col("k"))


def sampled_frames(movie: DataFrame, n_frames: int, most: int, chunk: int = 1000, seed: int = 0) -> DataFrame:
    """Whole chunks of neighbouring frames, chosen by a seed without replacement, of about `most` frames together."""
    if n_frames <= most:
        return movie
    starts = list(range(0, n_frames, chunk))
    use = sorted(np.random.default_rng(seed).choice(len(starts), max(1, min(len(starts), most // chunk)), replace=False).tolist())
    return movie.where(F.expr(f"frame div {chunk}").isin(use))


def regressed(u: DataFrame, movie: DataFrame, image: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """comp, frame, value: U' ((Y - mean) / std) for a movie (pixel, frame, v); image: pixel, mean, std; weights fold into U."""
    if weights is not None:
        u = u.join(weights.select("pixel", "weight"), "pixel").select("pixel", "comp", (F.col("value") * F.col("weight")).alias("value"))
    if image is None:
        return u.join(movie, "pixel").groupBy("comp", "frame").agg(F.sum(F.col("value") * F.col("v")).alias("value"))
    scaled = u.join(image.select("pixel", "mean", "std"), "pixel").select("pixel", "comp", (F.col("value") / F.col("std")).alias("value"), "mean")
    return scaled.join(movie, "pixel").groupBy("comp", "frame").agg(F.sum(F.col("value") * (F.col("v") - F.col("mean"))).alias("value"))


def rescaled(product: DataFrame, image: DataFrame) -> DataFrame:
    """pixel, frame, value of a factored movie in the raw movie's units: value std + mean."""
    return product.join(image.select("pixel", "mean", "std"), "pixel").select("pixel", "frame", (F.col("value") * F.col("std") + F.col("mean")).alias("value"))


def factors_of(compressed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u (pixel, comp, value), blended over blocks that kept components, and v (comp, frame, value)."""
    rows = compressed.select("block", "comp", F.explode(F.arrays_zip("pixels", "basis", "weights")).alias("z")).select("block", "comp", F.col("z.pixels").alias("pixel"), F.col("z.basis").alias("basis"), F.col("z.weights").alias("weight"))
    total = rows.select("block", "pixel", "weight").distinct().groupBy("pixel").agg(F.sum("weight").alias("total"))
    u = rows.join(total, "pixel").select("pixel", "comp", (F.col("basis") * F.col("weight") / F.col("total")).alias("value"))
    v = compressed.select("comp", F.explode(F.arrays_zip("frames", "trace")).alias("z")).select("comp", F.col("z.frames").alias("frame"), F.col("z.trace").alias("value"))
    return u, v


def filtered_traces(traces: DataFrame, cutoff: float, rate: float, order: int = 5) -> DataFrame:
    """comp, trace: a zero-phase Butterworth high-pass of each row's array."""
    b, a = lowrank.butterworth_highpass(order, cutoff, rate)

    def apply(parts):
        for part in parts:
            yield part.assign(trace=[lowrank.zero_phase(b, a, np.asarray(x, float)[None])[0].tolist() for x in part["trace"]])

    return traces.mapInPandas(apply, traces.schema)
