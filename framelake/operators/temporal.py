"""Operators along time: crops, moving medians, filters by neighbouring frames, events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["y", "x"]


def cropped(movie: DataFrame, first: int, last: int) -> DataFrame:
    """The movie without its first and last frames; its length is one aggregate, the rest a filter at the scan."""
    n = movie.agg(F.max("frame")).first()[0]
    return movie.where((F.col("frame") >= first) & (F.col("frame") <= (n if n is not None else -1) - last))


def minus_moving_median(movie: DataFrame, window: int = 8) -> DataFrame:
    """v less the median of `window` frames around (half before, the rest from itself on); half a window at either end is 0."""
    pixel, half = Window.partitionBy(*PIXEL), window // 2
    near = F.sort_array(F.collect_list("v").over(pixel.orderBy("frame").rowsBetween(-half, window - half - 1)))
    rows = movie.withColumns({"near": near, "nth": F.row_number().over(pixel.orderBy("frame")), "n": F.count("*").over(pixel)})
    middle = (F.expr("element_at(near, int((size(near) + 1) div 2))") + F.expr("element_at(near, int(size(near) div 2 + 1))")) / 2
    inside = (F.col("nth") > half) & (F.col("nth") <= F.col("n") - half)
    return rows.select("frame", *PIXEL, F.when(inside, F.col("v") - middle).otherwise(0.0).alias("v"))


def difference_of_gaussians(width: int = 19, narrow: float = 1.0, wide: float = 3.0) -> list[float]:
    """Weights of a band-pass along time: a narrow bell less a wide one of the same area, its peak 1."""
    places = [i - (width - 1) / 2 for i in range(width)]
    bell = lambda s: [math.exp(-(p * p) / (2 * s * s)) for p in places]
    area = lambda w: sum((a + b) / 2 for a, b in zip(w, w[1:]))  # noqa: E731, B905
    n, w = bell(narrow), bell(wide)
    out = [x - y * area(n) / area(w) for x, y in zip(n, w, strict=True)]
    return [x / max(out) for x in out]


def weighted_frames(movie: DataFrame, weights: list[float]) -> DataFrame:
    """Each pixel's trace correlated with weights around it; frames beyond the ends count as 0."""
    half, order = len(weights) // 2, Window.partitionBy(*PIXEL).orderBy("frame")
    terms = [F.lag("v", half - i, 0.0).over(order) * F.lit(w) for i, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return movie.select("frame", *PIXEL, total.alias("v"))


def region_traces(movie: DataFrame, regions: DataFrame) -> DataFrame:
    """label, frame, v: the mean of the movie over each region (label, y, x)."""
    return movie.join(regions.select("label", *PIXEL), PIXEL).groupBy("label", "frame").agg(F.avg("v").alias("v"))


def region_events(traces: DataFrame, factor: float = 5.0, first: int = 10, last: int = 350, apart: int = 10) -> DataFrame:
    """label, frame, v: strict peaks above a multiple of the baseline's deviation, each alone within `apart` frames.

    Of peaks that follow each other closely a run keeps one only if its first and its last are the same, as both the
    highest and the lowest of a run must stay.
    """
    std = traces.where(F.col("frame").between(first - 1, last - 1)).groupBy("label").agg(F.stddev_samp("v").alias("std"))
    w = Window.partitionBy("label").orderBy("frame")
    cut = traces.join(std, "label").withColumn("v", F.when(F.col("v") < factor * F.col("std"), 0.0).otherwise(F.col("v")))
    peaks = cut.withColumns({"before": F.lag("v").over(w), "after": F.lead("v").over(w)}).where("v > before AND v > after").select("label", "frame", "v")
    alone = (F.coalesce(F.col("frame") - F.lag("frame").over(w), F.lit(apart + 1)) > apart) & (F.coalesce(F.lead("frame").over(w) - F.col("frame"), F.lit(apart + 1)) > apart)
    return peaks.withColumn("alone", alone).where("alone").drop("alone")


def event_stacks(movie: DataFrame, events: DataFrame, reach: int = 3) -> DataFrame:
    """label, event, y, x, v: the maximum of the frames around each event (label, frame)."""
    near = events.select("label", F.col("frame").alias("event"), F.explode(F.sequence(F.col("frame") - reach, F.col("frame") + reach)).alias("frame"))
    return movie.join(near, "frame").groupBy("label", "event", *PIXEL).agg(F.max("v").alias("v"))


def cluster_footprints(movie: DataFrame, clusters: DataFrame, reach: int = 5) -> DataFrame:
    """cluster, y, x, value: the mean frame of each cluster's events (cluster, frame), cut to a box around its peak."""
    mean = movie.join(clusters.select("cluster", "frame"), "frame").groupBy("cluster", *PIXEL).agg(F.avg("v").alias("value"))
    peak = mean.groupBy("cluster").agg(F.max_by(F.struct("y", "x"), F.struct(F.round("value", 9), -F.col("x"), -F.col("y"))).alias("p"))
    box = (F.abs(F.col("y") - F.col("p.y")) <= reach) & (F.abs(F.col("x") - F.col("p.x")) <= reach)
    return mean.join(peak, "cluster").where(box).select("cluster", *PIXEL, "value")


def region_projection(movie: DataFrame, regions: DataFrame) -> DataFrame:
    """label, cy, cx: the squared-weight centre of the movie's maximum over each region (label, y, x)."""
    top = movie.groupBy(*PIXEL).agg(F.max("v").alias("w"))
    square = F.col("w") * F.col("w")
    centre = lambda c: (F.sum(F.col(c) * square) / F.sum(square)).alias(f"c{c}")
    return regions.select("label", *PIXEL).join(top, PIXEL).groupBy("label").agg(centre("y"), centre("x"))


def normalised_snippets(traces: DataFrame, window: int, stride: int, least: float = 1e-6) -> DataFrame:
    """comp, start, i, value: windows of traces (comp, frame, value) with some deviation, centred and scaled to length 1.

    Frames count from 0, and the last window ends with the last frame of all traces. Moments are one aggregate and each row
    finds its own windows, so no trace is held in one row. The join is null-safe and the windows are nulls where a row is
    outside, as filters on comp or frame would go below the traces' own exchange in one branch and keep it from being reused.
    """
    stats = traces.groupBy("comp").agg(F.avg("value").alias("mean"), F.sqrt(F.var_pop("value") * F.count("value")).alias("norm"), F.stddev_samp("value").alias("std"), F.max("frame").alias("end"))
    some = stats.agg(F.collect_list(F.struct("comp", "mean", "norm", "std")).alias("all"), F.greatest(F.max("end") + 1 - window, F.lit(0)).alias("last"))
    some = some.select(F.inline("all"), "last").where(F.col("std") > least).withColumnRenamed("comp", "of")
    rows = traces.join(F.broadcast(some), F.col("comp").eqNullSafe(F.col("of")))
    regular = [(F.expr(f"frame div {stride}") - k) * stride for k in range(-(-window // stride))]
    starts = [F.when(s.between(0, F.col("last")) & (F.col("frame") >= s) & (F.col("frame") < s + window), s) for s in [*regular, F.when(F.col("last") % stride != 0, F.col("last"))]]
    rows = rows.withColumn("start", F.explode(F.array(*starts))).where("start IS NOT NULL")
    value = (F.col("value") - F.col("mean")) / F.col("norm")
    return rows.select("comp", F.col("start").cast("int").alias("start"), (F.col("frame") - F.col("start")).cast("int").alias("i"), value.alias("value"))
