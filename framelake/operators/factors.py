"""Operators on factor tables: footprints a or u (pixel, comp, value), traces c or v (comp, frame, value).

A product of two factors is an equi-join on the shared axis and a grouped sum. Chains are written so that the
small product comes first: Gram tables (comp x comp) never grow with the number of frames or pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def product(u: DataFrame, v: DataFrame) -> DataFrame:
    """pixel, frame, value of U V."""
    r = v.withColumnRenamed("value", "w")
    return u.join(r, "comp").groupBy("pixel", "frame").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def project(u: DataFrame, movie: DataFrame) -> DataFrame:
    """comp, frame, value of U' Y for a movie (pixel, frame, v)."""
    return u.join(movie, "pixel").groupBy("comp", "frame").agg(F.sum(F.col("value") * F.col("v")).alias("value"))


def rank_image(u: DataFrame) -> DataFrame:
    return u.groupBy("pixel").agg(F.count("*").alias("rank"))


def gram(a: DataFrame, b: DataFrame, axis: str) -> DataFrame:
    """ka, kb, value: inner products of the components of two tables over an axis."""
    left = a.select(axis, F.col("comp").alias("ka"), F.col("value").alias("va"))
    right = b.select(axis, F.col("comp").alias("kb"), F.col("value").alias("vb"))
    return left.join(right, axis).groupBy("ka", "kb").agg(F.sum(F.col("va") * F.col("vb")).alias("value"))


def near_gram(c: DataFrame, a: DataFrame, axis: str = "frame") -> DataFrame:
    """ka, kb, value: inner products over frames of the traces whose footprints share a pixel, and of each with itself."""
    on = a.select("pixel", F.col("comp").alias("ka"))  # explicit zeros count, as an update may fill them
    wanted = on.join(on.withColumnRenamed("ka", "kb"), "pixel").select("ka", "kb").distinct()
    left = c.select(axis, F.col("comp").alias("ka"), F.col("value").alias("va"))
    right = c.select(axis, F.col("comp").alias("kb"), F.col("value").alias("vb"))
    return left.join(wanted, "ka").join(right, [axis, "kb"]).groupBy("ka", "kb").agg(F.sum(F.col("va") * F.col("vb")).alias("value"))


def cross(u: DataFrame, small: DataFrame) -> DataFrame:
    """pixel, comp, g: U G for a table of inner products G (ka over U's components, kb)."""
    g = small.select(F.col("ka").alias("r"), F.col("kb").alias("comp"), F.col("value").alias("w"))
    return u.select("pixel", F.col("comp").alias("r"), F.col("value").alias("z")).join(g, "r").groupBy("pixel", "comp").agg(F.sum(F.col("w") * F.col("z")).alias("g"))


def mean_product(u: DataFrame, v: DataFrame) -> DataFrame:
    """pixel, mean of U V over frames, from the means of V alone."""
    m = v.groupBy("comp").agg(F.avg("value").alias("m"))
    return u.join(m, "comp").groupBy("pixel").agg(F.sum(F.col("value") * F.col("m")).alias("mean"))


def baseline(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame) -> DataFrame:
    """pixel, b: mean of U V less A times the means of C."""
    both = mean_product(u, v).union(mean_product(a, c).select("pixel", -F.col("mean")))
    return both.groupBy("pixel").agg(F.sum("mean").alias("b"))


def squared_norms(a: DataFrame) -> DataFrame:
    return a.groupBy("comp").agg(F.sum(F.col("value") * F.col("value")).alias("norm2"))


def temporal_step(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame, b: DataFrame, nonneg: bool = True) -> DataFrame:
    """One pass of hierarchical least squares on the traces, all components at once.

    c + (A'(U V - b) - A'A c) / |a|^2. Components that overlap belong in different calls, by colour.
    """
    au = gram(a, u, "pixel").select(F.col("ka").alias("comp"), F.col("kb").alias("r"), F.col("value").alias("w"))
    data = au.join(v.select(F.col("comp").alias("r"), "frame", F.col("value").alias("z")), "r").groupBy("comp", "frame").agg(F.sum(F.col("w") * F.col("z")).alias("g"))
    aa = gram(a, a, "pixel").select(F.col("ka").alias("comp"), F.col("kb").alias("k"), F.col("value").alias("w"))
    own = aa.join(c.select(F.col("comp").alias("k"), "frame", F.col("value").alias("z")), "k").groupBy("comp", "frame").agg(F.sum(F.col("w") * F.col("z")).alias("h"))
    ab = a.join(b, "pixel").groupBy("comp").agg(F.sum(F.col("value") * F.col("b")).alias("ab"))
    new = c.join(data, ["comp", "frame"]).join(own, ["comp", "frame"]).join(ab, "comp").join(squared_norms(a), "comp")
    value = F.col("value") + (F.col("g") - F.col("h") - F.col("ab")) / F.col("norm2")
    return new.select("comp", "frame", (F.greatest(value, F.lit(0.0)) if nonneg else value).alias("value"))


def spatial_step(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame, b: DataFrame) -> DataFrame:
    """One pass on the footprints, within their support, kept non-negative."""
    vc = gram(v, c, "frame").select(F.col("ka").alias("r"), F.col("kb").alias("comp"), F.col("value").alias("w"))
    data = u.select("pixel", F.col("comp").alias("r"), F.col("value").alias("z")).join(vc, "r").groupBy("pixel", "comp").agg(F.sum(F.col("w") * F.col("z")).alias("g"))
    cc = near_gram(c, a).select(F.col("ka").alias("k"), F.col("kb").alias("comp"), F.col("value").alias("w"))
    own = a.select("pixel", F.col("comp").alias("k"), F.col("value").alias("z")).join(cc, "k").groupBy("pixel", "comp").agg(F.sum(F.col("w") * F.col("z")).alias("h"))
    sums = c.groupBy("comp").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("norm2"))
    new = a.join(data, ["pixel", "comp"], "left").join(own, ["pixel", "comp"]).join(b, "pixel").join(sums, "comp")
    value = F.col("value") + (F.coalesce("g", F.lit(0.0)) - F.col("h") - F.col("b") * F.col("s")) / F.col("norm2")
    return new.select("pixel", "comp", F.greatest(value, F.lit(0.0)).alias("value"))


def standard_correlation(u: DataFrame, v: DataFrame, c: DataFrame, n_frames: int, noise: float = 0.0) -> DataFrame:
    """pixel, comp, corr of U V with each trace; pixel norms come from the Gram table of V."""
    mean = v.groupBy("comp").agg(F.avg("value").alias("m"))
    vz = v.join(mean, "comp").select("comp", "frame", (F.col("value") - F.col("m")).alias("value"))
    cz = c.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("comp")))
    vv = near_gram(vz, u).withColumnRenamed("value", "w")  # only pairs that share a pixel are multiplied over frames
    left, right = (u.select("pixel", F.col("comp").alias(k), F.col("value").alias(n)) for k, n in (("ka", "p"), ("kb", "q")))
    norm = left.join(right, "pixel").join(vv, ["ka", "kb"]).groupBy("pixel").agg((F.sum(F.col("p") * F.col("q") * F.col("w")) + noise * noise * n_frames).alias("n2"))
    vc = gram(vz, cz, "frame").select(F.col("ka").alias("r"), F.col("kb").alias("comp"), F.col("value").alias("w"))
    top = u.select("pixel", F.col("comp").alias("r"), F.col("value").alias("z")).join(vc, "r").groupBy("pixel", "comp").agg(F.sum(F.col("z") * F.col("w")).alias("s"))
    low = squared_norms(cz)
    value = F.when((F.col("n2") < 1e-12) | (F.col("norm2") < 1e-12), 0.0).otherwise(F.col("s") / F.sqrt(F.col("n2") * F.col("norm2")))
    return top.join(norm, "pixel").join(low, "comp").select("pixel", "comp", value.alias("corr"))


def signed_sum(*terms: tuple[float, DataFrame]) -> DataFrame:
    """pixel, frame, value: a sum of movies (pixel, frame, value) with weights, as one union and one grouping."""
    parts = [m.select("pixel", "frame", (F.col("value") * w).alias("value")) for w, m in terms]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("pixel", "frame").agg(F.sum("value").alias("value"))


def roi_averages(a: DataFrame, movie: DataFrame) -> DataFrame:
    """comp, frame, mean of a movie (pixel, frame, value) over each footprint's support."""
    return a.where("value <> 0").select("pixel", "comp").join(movie, "pixel").groupBy("comp", "frame").agg(F.avg("value").alias("mean"))


def overlap_edges(a: DataFrame) -> DataFrame:
    """src < dst and the number of pixels shared, for the update schedule."""
    s = a.where("value <> 0").select("pixel", F.col("comp").alias("src"))
    return s.join(s.select("pixel", F.col("src").alias("dst")), "pixel").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))


def brightness(a: DataFrame, c: DataFrame) -> DataFrame:
    """comp, brightness and rank by max |a| max |c|, brightest first."""
    m = lambda t, n: t.groupBy("comp").agg(F.max(F.abs("value")).alias(n))
    out = m(a, "p").join(m(c, "q"), "comp").select("comp", (F.col("p") * F.col("q")).alias("brightness"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("brightness"), "comp")))


def cosine(a: DataFrame, b: DataFrame, axis: str) -> DataFrame:
    """ka, kb, cosine of the components of two tables."""
    na, nb = squared_norms(a).withColumnsRenamed({"comp": "ka", "norm2": "na"}), squared_norms(b).withColumnsRenamed({"comp": "kb", "norm2": "nb"})
    return gram(a, b, axis).join(na, "ka").join(nb, "kb").select("ka", "kb", (F.col("value") / F.sqrt(F.col("na") * F.col("nb"))).alias("cosine"))


def unmatched(a1: DataFrame, c1: DataFrame, a2: DataFrame, c2: DataFrame, space: float, time: float) -> DataFrame:
    """Components of the first pipeline whose best spatial and best temporal cosine are both under the ceilings."""
    best = lambda t, n: t.groupBy("ka").agg(F.max("cosine").alias(n))
    every = a1.select(F.col("comp").alias("ka")).distinct()
    found = every.join(best(cosine(a1, a2, "pixel"), "s"), "ka", "left").join(best(cosine(c1, c2, "frame"), "t"), "ka", "left")
    return found.where((F.coalesce("s", F.lit(0.0)) < space) & (F.coalesce("t", F.lit(0.0)) < time)).select(F.col("ka").alias("comp"))


def centres(a: DataFrame, width: int) -> DataFrame:
    """comp, cy, cx: centres of mass; explicit zeros weigh nothing."""
    w = a.where("value <> 0")
    mean = lambda e: F.sum(F.expr(e) * F.col("value")) / F.sum("value")
    return w.groupBy("comp").agg(mean(f"pixel div {width}").alias("cy"), mean(f"pixel % {width}").alias("cx"))


def boxes(a: DataFrame, width: int) -> DataFrame:
    w = a.where("value <> 0").selectExpr("comp", f"pixel div {width} AS y", f"pixel % {width} AS x")
    return w.groupBy("comp").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def posterior_mix(predicted: DataFrame, noise: DataFrame) -> DataFrame:
    """w mu + (1 - w) x, w = noise / max(total, noise), for rows comp, frame, x, mu, total."""
    w = F.when(F.greatest("total", "noise") == 0, 0.0).otherwise(F.col("noise") / F.greatest("total", "noise"))
    return predicted.join(noise, "comp").select("comp", "frame", (w * F.col("mu") + (1 - w) * F.col("x")).alias("value"))


def snippets(traces: DataFrame, n_frames: int | None, window: int, stride: int) -> DataFrame:
    """comp, start, snippet of a table comp, trace (array); the last window is anchored to the end.

    n_frames None: windows over the whole of each trace.
    """
    if n_frames is None:
        last = F.greatest(F.size("trace") - window, F.lit(0))
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    else:
        starts = F.array(*map(F.lit, sorted({*range(0, max(1, n_frames - window + 1), stride), max(0, n_frames - window)})))
    return traces.withColumn("start", F.explode(starts)).select("comp", "start", F.expr(f"slice(trace, start + 1, {window})").alias("snippet"))


def overlap_average(windows: DataFrame) -> DataFrame:
    """comp, frame, value: windows of outputs averaged where they overlap."""
    rows = windows.select("comp", "start", F.posexplode("snippet").alias("i", "z"))
    return rows.groupBy("comp", (F.col("start") + F.col("i")).alias("frame")).agg(F.avg("z").alias("value"))


def peak_order(c: DataFrame) -> DataFrame:
    """comp, rank by the peak of the trace scaled to length 1, highest first."""
    peak = c.groupBy("comp").agg(F.round(F.max("value") / F.sqrt(F.sum(F.col("value") * F.col("value"))), 9).alias("peak"))
    return peak.select("comp", F.row_number().over(Window.orderBy(F.desc("peak"), "comp")).alias("rank"))  # one row a component


def in_window(a: DataFrame, width: int, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """comp of the components with a pixel in a window (ends excluded)."""
    row, column = F.expr(f"pixel div {width}"), F.expr(f"pixel % {width}")
    return a.where((row >= y[0]) & (row < y[1]) & (column >= x[0]) & (column < x[1])).select("comp").distinct()


def chosen(table: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of the named components (comp)."""
    return table.join(names.select("comp").distinct(), "comp", "left_semi")


def mean_trace(c: DataFrame) -> DataFrame:
    """frame, value: the mean of all traces, cut at 0."""
    return c.groupBy("frame").agg(F.greatest(F.avg("value"), F.lit(0.0)).alias("value"))


def rank1_spatial(a: DataFrame, c: DataFrame, trace: DataFrame) -> DataFrame:
    """pixel, value: A C regressed on one trace (frame, value), cut at 0; C meets the trace first, so no frame meets a pixel."""
    dots = c.join(trace.withColumnRenamed("value", "t"), "frame").groupBy("comp").agg(F.sum(F.col("value") * F.col("t")).alias("w"))
    size = trace.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 1.0
    return a.join(dots, "comp").groupBy("pixel").agg(F.greatest(F.sum(F.col("value") * F.col("w")) / F.lit(size), F.lit(0.0)).alias("value"))


def rank1_temporal(a: DataFrame, c: DataFrame, image: DataFrame) -> DataFrame:
    """frame, value: A C regressed on one image (pixel, value), cut at 0."""
    dots = a.join(image.withColumnRenamed("value", "t"), "pixel").groupBy("comp").agg(F.sum(F.col("value") * F.col("t")).alias("w"))
    size = image.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 1.0
    return c.join(dots, "comp").groupBy("frame").agg(F.greatest(F.sum(F.col("value") * F.col("w")) / F.lit(size), F.lit(0.0)).alias("value"))


def colours(a: DataFrame) -> DataFrame:
    """comp, red, green, blue: a fixed colour for each component."""
    shade = lambda p, q: ((F.col("comp") * p + q) % 100).cast("double")
    return a.select("comp").distinct().select("comp", shade(37, 11).alias("red"), shade(53, 29).alias("green"), shade(71, 47).alias("blue"))


def colour_projection(a: DataFrame, shades: DataFrame) -> DataFrame:
    """pixel, red, green, blue: footprints in their colours, added up."""
    return a.join(shades, "comp").groupBy("pixel").agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in ("red", "green", "blue")])


def colour_maximum(a: DataFrame, c: DataFrame, shades: DataFrame) -> DataFrame:
    """The same, each footprint times its trace's range, and each pixel over its strongest channel."""
    top = c.groupBy("comp").agg((F.max("value") - F.min("value")).alias("top"))
    bright = a.join(top, "comp").select("pixel", "comp", (F.col("value") * F.col("top")).alias("value"))
    most = F.greatest("red", "green", "blue")
    return colour_projection(bright, shades).where(most > 0).select("pixel", *[(F.col(n) / most).alias(n) for n in ("red", "green", "blue")])


def roi_panel(a: DataFrame, u: DataFrame, v: DataFrame, b: DataFrame) -> DataFrame:
    """comp, frame, scaled, base: a factored movie's mean over each support and the baseline's, over the former's maximum."""
    on = a.where("value <> 0").select("pixel", F.col("comp").alias("roi"))
    mean = roi_averages(a, product(u.join(on.select("pixel").distinct(), "pixel", "left_semi"), v))
    base = on.join(b, "pixel").groupBy(F.col("roi").alias("comp")).agg(F.avg("b").alias("base"))
    top = mean.groupBy("comp").agg(F.max("mean").alias("top"))
    return mean.join(base, "comp").join(top, "comp").select("comp", "frame", (F.col("mean") / F.col("top")).alias("scaled"), (F.col("base") / F.col("top")).alias("base"))


def fetched(movie: DataFrame, pixels: list[int]) -> DataFrame:
    """The traces of listed pixels, as a filter at the scan."""
    return movie.where(F.col("pixel").isin(pixels))


def dense(a: DataFrame, n_pixels: int) -> DataFrame:
    """All pixels of every component, absent ones 0."""
    every = a.select("comp").distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pixels - 1).cast("long"))).alias("pixel"), "comp")
    return every.join(a, ["pixel", "comp"], "left").select("pixel", "comp", F.coalesce("value", F.lit(0.0)).alias("value"))


def sparse(a: DataFrame) -> DataFrame:
    return a.where("value <> 0")


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pixel"), F.col("id").cast("int").alias("comp"), F.lit(1.0).alias("value"))


def noise_quantile(predicted: DataFrame, quantile: float) -> DataFrame:
    """comp, noise: a quantile of each trace's predicted variance (comp, frame, total); quantile 0 gives 0."""
    noise = F.expr(f"percentile(total, {quantile})") if quantile else F.lit(0.0)
    return predicted.groupBy("comp").agg(noise.alias("noise"))


def least_squares_traces(a: DataFrame, movie: DataFrame) -> DataFrame:
    """comp, frame, value: traces by the pseudo-inverse of the footprints, each over its maximum.

    The components' Gram table, one number a pair, is inverted on the driver; the movie meets the footprints once.
    """
    import numpy as np

    g = gram(a, a, "pixel").toPandas()
    names = sorted(set(g["ka"]))
    nth = {k: i for i, k in enumerate(names)}
    table = np.zeros((len(names),) * 2)
    table[g["ka"].map(nth), g["kb"].map(nth)] = g["value"]
    inverse = np.linalg.pinv(table)
    rows = [(k, o, float(inverse[nth[k], nth[o]])) for k in names for o in names if inverse[nth[k], nth[o]]]
    kind = a.schema["comp"].dataType.simpleString()
    mix = a.sparkSession.createDataFrame(rows, f"comp {kind}, r {kind}, w double")
    raw = project(a, movie).select(F.col("comp").alias("r"), "frame", F.col("value").alias("z"))
    out = raw.join(mix, "r").groupBy("comp", "frame").agg(F.sum(F.col("w") * F.col("z")).alias("value"))
    return out.withColumn("value", F.col("value") / F.max("value").over(Window.partitionBy("comp")))
