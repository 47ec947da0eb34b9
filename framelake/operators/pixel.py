"""Per-pixel and per-frame operators on movies (frame, y, x, v).

All are grouped by pixel or by frame, so a movie of any length is one partial aggregation and one shuffle;
images (one row a pixel) are joined as they are, and Catalyst broadcasts those that are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import EIGHT, HALF, at_offsets, disk

PIXEL = ["y", "x"]


def frames(movie: DataFrame, first: int, last: int, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """Frames first to last - 1 and a crop; all of it reaches the scan as a filter."""
    out = movie.where((F.col("frame") >= first) & (F.col("frame") < last))
    for axis, ends in (("y", y), ("x", x)):
        if ends:
            out = out.where((F.col(axis) >= ends[0]) & (F.col(axis) < ends[1]))
    return out


def mean_image(movie: DataFrame) -> DataFrame:
    return movie.groupBy(*PIXEL).agg(F.avg("v").alias("mean"))


def minus_image(movie: DataFrame, image: DataFrame, column: str) -> DataFrame:
    """The movie less an image."""
    return movie.join(image.select(*PIXEL, column), PIXEL).withColumn("v", F.col("v") - F.col(column)).drop(column)


def saturated(movie: DataFrame, limit: float) -> DataFrame:
    """Pixels that exceed the limit in any frame."""
    return movie.groupBy(*PIXEL).agg(F.max((F.col("v") > limit).cast("int")).alias("saturated"))


def dilated(mask: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Pixels within a disk of a masked one, inside the field of view."""
    moved = at_offsets(mask.select(*PIXEL), disk(radius)).select(*PIXEL).distinct()
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def border_weights(image: DataFrame, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """1 for pixels that no shift (frame, dy, dx) brings in from outside, else 0."""
    s = shifts.agg(*[f(c).alias(f"{n}_{c}") for c in ("dy", "dx") for n, f in (("lo", F.min), ("hi", F.max))])
    s = s.select(*[F.abs(F.floor(F.least(F.col(f"lo_{c}"), F.lit(0.0)))).alias(f"neg_{c}") for c in ("dy", "dx")], *[F.ceil(F.greatest(F.col(f"hi_{c}"), F.lit(0.0))).alias(f"pos_{c}") for c in ("dy", "dx")]).first()
    inside = (F.col("y") >= s["pos_dy"]) & (F.col("y") < height - s["neg_dy"]) & (F.col("x") >= s["pos_dx"]) & (F.col("x") < width - s["neg_dx"])
    return image.select(*PIXEL, F.when(inside, 1.0).otherwise(0.0).alias("weight"))


def median_image(movie: DataFrame, first: int = 500) -> DataFrame:
    """The first template: the median of the first frames."""
    return movie.where(F.col("frame") < first).groupBy(*PIXEL).agg(F.median("v").alias("template"))


def mad_bounds(movie: DataFrame) -> DataFrame:
    """Lower median and lower median absolute deviation of each pixel."""
    med = movie.groupBy(*PIXEL).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("med"))
    dev = movie.join(med, PIXEL).withColumn("d", F.abs(F.col("v") - F.col("med")))
    return dev.groupBy(*PIXEL).agg(F.first("med").alias("med"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias("mad"))


def mad_kept(movie: DataFrame, k: float) -> DataFrame:
    """Values at least k deviations from the median, of both tails; other rows are dropped."""
    return movie.join(mad_bounds(movie), PIXEL).where(F.abs(F.col("v") - F.col("med")) >= k * F.col("mad")).select("frame", *PIXEL, "v")


def spikes(movie: DataFrame, k: float) -> DataFrame:
    """max(0, v - median - k MAD), with averaged medians."""
    med = movie.groupBy(*PIXEL).agg(F.median("v").alias("med"))
    mad = movie.join(med, PIXEL).groupBy(*PIXEL).agg(F.first("med").alias("med"), F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    return movie.join(mad, PIXEL).select("frame", *PIXEL, F.greatest(F.col("v") - F.col("med") - k * F.col("mad"), F.lit(0.0)).alias("v"))


def noise_image(movie: DataFrame) -> DataFrame:
    """mean and noise std sqrt(E d^2 - lag-1 covariance); a variance under 1e-8 gives 1."""
    centred = movie.withColumn("m", F.avg("v").over(Window.partitionBy(*PIXEL))).withColumn("d", F.col("v") - F.col("m"))
    lagged = centred.withColumn("p", F.lag("d").over(Window.partitionBy(*PIXEL).orderBy("frame")))
    var = F.avg(F.col("d") * F.col("d")) - F.avg(F.col("d") * F.col("p"))
    return lagged.groupBy(*PIXEL).agg(F.first("m").alias("mean"), F.when(var < 1e-8, 1.0).otherwise(F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"))


def standardised(movie: DataFrame) -> DataFrame:
    """(v - mean) / noise std."""
    return movie.join(noise_image(movie), PIXEL).select("frame", *PIXEL, F.nanvl((F.col("v") - F.col("mean")) / F.col("std"), F.lit(0.0)).alias("v"))


def convolved(movie: DataFrame, kernel: list[list[float]], height: int, width: int) -> DataFrame:
    """Each frame convolved (correlated) with a small odd kernel, edges reflected.

    The kernel is a few dozen rows joined to the pixels of one image; the movie meets that map once.
    """
    r, c = len(kernel) // 2, len(kernel[0]) // 2
    taps = F.array(*[F.struct(F.lit(i - r).alias("dy"), F.lit(j - c).alias("dx"), F.lit(float(k)).alias("k")) for i, row in enumerate(kernel) for j, k in enumerate(row)])
    mirror = lambda p, n: F.when(p < 0, -p).when(p >= n, 2 * (n - 1) - p).otherwise(p)
    spark = movie.sparkSession
    grid = spark.range(height * width).select((F.col("id") / width).cast("int").alias("ty"), (F.col("id") % width).cast("int").alias("tx")).withColumn("t", F.explode(taps))
    taken = grid.select("ty", "tx", mirror(F.col("ty") + F.col("t.dy"), height).alias("y"), mirror(F.col("tx") + F.col("t.dx"), width).alias("x"), F.col("t.k").alias("k")).groupBy("ty", "tx", "y", "x").agg(F.sum("k").alias("k"))
    return movie.join(taken, PIXEL).groupBy("frame", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("v") * F.col("k")).alias("v"))


def time_binned(movie: DataFrame, n: int) -> DataFrame:
    """Mean of n frames each; the last bin may be partial."""
    return movie.groupBy(F.expr(f"frame div {n}").alias("bin"), *PIXEL).agg(F.avg("v").alias("v"))


def space_binned(movie: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """Mean of n x n pixels; incomplete edges are dropped."""
    kept = movie.where((F.col("y") < height // n * n) & (F.col("x") < width // n * n))
    return kept.groupBy("frame", F.expr(f"y div {n}").alias("by"), F.expr(f"x div {n}").alias("bx")).agg(F.avg("v").alias("v"))


def temporal_roughness(traces: DataFrame, key: str, value: str) -> DataFrame:
    """Mean absolute second difference over mean absolute value (0 counts as 1)."""
    w = Window.partitionBy(key).orderBy("frame")
    second = F.abs(F.lag(value).over(w) + F.lead(value).over(w) - 2 * F.col(value))
    some = traces.withColumn("second", second).groupBy(key).agg(F.avg("second").alias("top"), F.avg(F.abs(F.col(value))).alias("low"))
    return some.select(key, (F.col("top") / F.when(F.col("low") == 0, 1.0).otherwise(F.col("low"))).alias("roughness"))


def spatial_roughness(movie: DataFrame, both_diagonals: bool = False) -> DataFrame:
    """Mean absolute neighbour difference over mean absolute value of each frame.

    One diagonal counts twice and the other not at all, as thresholds elsewhere are calibrated that way.
    """
    steps = [(1, 0), (0, 1), (1, 1), (1, -1) if both_diagonals else (1, 1)]
    weights = {o: steps.count(o) for o in steps}
    near = at_offsets(movie, list(weights)).select("frame", "y", "x", F.col("v").alias("u"), "dy", "dx")
    weight = F.coalesce(*[F.when((F.col("dy") == dy) & (F.col("dx") == dx), float(w)) for (dy, dx), w in weights.items()])
    diff = near.join(movie, ["frame", *PIXEL]).groupBy("frame").agg(F.sum(weight * F.abs(F.col("v") - F.col("u"))).alias("s"), F.sum(weight).alias("n"))
    level = movie.groupBy("frame").agg(F.avg(F.abs(F.col("v"))).alias("low"))
    return diff.join(level, "frame").select("frame", (F.col("s") / F.col("n") / F.when(F.col("low") == 0, 1.0).otherwise(F.col("low"))).alias("roughness"))


def failure_cut(decisions: DataFrame, limit: int, key: str = "block", order: str = "comp", ok: str = "ok") -> DataFrame:
    """Components up to and with the one that makes `limit` failures in a row; early failures stay."""
    w = Window.partitionBy(key).orderBy(order)
    runs = decisions.withColumn("bad", F.sum((~F.col(ok)).cast("int")).over(w.rowsBetween(-(limit - 1), 0)))
    hit = runs.withColumn("hits", F.sum((F.col("bad") == limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return hit.where(F.coalesce("hits", F.lit(0)) == 0).drop("bad", "hits")


def neighbour_correlation(movie: DataFrame, norms: DataFrame | None = None, noise: float = 0.0) -> DataFrame:
    """Mean correlation of each pixel with its neighbours, over frames that both have.

    Norms are over all frames a pixel has, plus its frames times noise^2, or given (y, x, n2). Only four directions are
    joined; each pair counts for both ends.
    """
    centred = movie.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy(*PIXEL)))
    frames = movie.agg(F.countDistinct("frame")).first()[0] if noise else 0
    norm = norms if norms is not None else centred.groupBy(*PIXEL).agg((F.sum(F.col("d") * F.col("d")) + F.lit(frames * noise * noise)).alias("n2"))
    near = at_offsets(centred.select("frame", *PIXEL, F.col("d").alias("e")), HALF)
    pair = near.join(centred.select("frame", *PIXEL, "d"), ["frame", *PIXEL]).groupBy(*PIXEL, "dy", "dx").agg(F.sum(F.col("d") * F.col("e")).alias("s"))
    other = norm.select((F.col("y")).alias("oy"), F.col("x").alias("ox"), F.col("n2").alias("m2"))
    pair = pair.withColumns({"oy": F.col("y") - F.col("dy"), "ox": F.col("x") - F.col("dx")}).join(norm, PIXEL).join(other, ["oy", "ox"])
    pair = pair.withColumn("c", F.when((F.col("n2") < 1e-12) | (F.col("m2") < 1e-12), 0.0).otherwise(F.col("s") / F.sqrt(F.col("n2") * F.col("m2"))))
    ends = pair.select(*PIXEL, "c").union(pair.select("oy", "ox", "c"))
    return ends.groupBy(*PIXEL).agg(F.avg("c").alias("corr"))


def squared_norms(movie: DataFrame) -> DataFrame:
    """y, x, n2: sum of squares around each pixel's mean."""
    return movie.groupBy(*PIXEL).agg((F.var_pop("v") * F.count("v")).alias("n2"))


def _three(raw: DataFrame, compressed: DataFrame, image) -> DataFrame:
    """y, x, raw, pmd, residual: an image of the raw movie, of the compressed one, and of their difference."""
    both = raw.join(compressed.withColumnRenamed("v", "w"), ["frame", *PIXEL])
    residual = both.select("frame", *PIXEL, (F.col("v") - F.col("w")).alias("v"))
    out = image(raw).withColumnsRenamed({"value": "raw"})
    for name, movie in (("pmd", compressed), ("residual", residual)):
        out = out.join(image(movie).withColumnsRenamed({"value": name}), PIXEL)
    return out


def three_correlations(raw: DataFrame, compressed: DataFrame) -> DataFrame:
    """Neighbour correlations of raw, compressed and residual movie, all over the raw movie's norms."""
    norms = squared_norms(raw)
    return _three(raw, compressed, lambda m: neighbour_correlation(m, norms).withColumnRenamed("corr", "value"))


def three_lag1(raw: DataFrame, compressed: DataFrame) -> DataFrame:
    """Lag-1 autocovariances of the three, all over the raw movie's squared norms (under 1e-6 counts as 1)."""
    low = squared_norms(raw).select(*PIXEL, F.when(F.sqrt("n2") < 1e-6, 1.0).otherwise(F.col("n2")).alias("low"))

    def image(movie):
        w = Window.partitionBy(*PIXEL)
        d = movie.withColumn("d", F.col("v") - F.avg("v").over(w)).withColumn("p", F.lag("d").over(w.orderBy("frame")))
        return d.groupBy(*PIXEL).agg(F.coalesce(F.sum(F.col("d") * F.col("p")), F.lit(0.0)).alias("top")).join(low, PIXEL).select(*PIXEL, (F.col("top") / F.col("low")).alias("value"))

    return _three(raw, compressed, image)


def lag1_image(movie: DataFrame, centred: bool = True) -> DataFrame:
    """Lag-1 autocovariance over the squared norm (under 1e-6 counts as 1), or the mean lag-1 product."""
    w = Window.partitionBy(*PIXEL)
    d = movie.withColumn("d", F.col("v") - (F.avg("v").over(w) if centred else F.lit(0.0)))
    d = d.withColumn("p", F.lag("d").over(w.orderBy("frame")))
    top, low = F.sum(F.col("d") * F.col("p")), F.sum(F.col("d") * F.col("d"))
    value = top / F.when(F.sqrt(low) < 1e-6, 1.0).otherwise(low) if centred else top / F.count("*")
    return d.groupBy(*PIXEL).agg(F.coalesce(value, F.lit(0.0)).alias("lag1"))


def local_peaks(image: DataFrame, radius: int, cutoff: float, height: int, width: int, column: str = "corr") -> DataFrame:
    """Pixels that equal the maximum of their window and exceed the cutoff; a border of one pixel never does."""
    # rounded, as the two sides may be summed in another order
    image = image.withColumn(column, F.round(column, 9))
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    top = at_offsets(image.select(*PIXEL, column), offsets).groupBy(*PIXEL).agg(F.max(column).alias("top"))
    inner = F.col("y").between(1, height - 2) & F.col("x").between(1, width - 2)
    return image.join(top, PIXEL).where((F.col(column) == F.col("top")) & (F.col(column) > cutoff) & inner).select(*PIXEL, column)


def contours(a: DataFrame, height: int, width: int) -> DataFrame:
    """The pixels next to a footprint (comp, y, x) and not in it."""
    ring = at_offsets(a.select("comp", *PIXEL), EIGHT).select("comp", *PIXEL).distinct()
    ring = ring.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return ring.join(a.select("comp", *PIXEL), ["comp", *PIXEL], "left_anti")


def ring_sum(image: DataFrame, radius: int, column: str = "value") -> DataFrame:
    """Sum over the ring of a pixel (distance within half a pixel of the radius), zero outside."""
    r = radius + 1
    ring = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if radius - 0.5 <= (dy * dy + dx * dx) ** 0.5 <= radius + 0.5]
    sums = at_offsets(image, ring).groupBy(*PIXEL).agg(F.sum(column).alias("ring"))
    return image.join(sums, PIXEL, "left").select(*PIXEL, F.coalesce("ring", F.lit(0.0)).alias("ring"))
