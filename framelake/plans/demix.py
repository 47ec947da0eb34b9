"""Signal demixing: seeds, alternating updates with background, merges, growing supports, and the results.

Frames are never multiplied by pixels: what a step needs are Gram tables of components, and only of pairs that meet at a
pixel. Tables that change are written once a half-round; what comes to the driver are component ids, edges between
components, and Gram tables of the background (its rank is bounded).
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.kernels import lowrank
from framelake.operators import background, factors, graph, pixel, spatial


@dataclass(frozen=True)
class DemixConfig:
    rounds: int = 25
    update_every: int = 4
    support_threshold: float | tuple[float, float] = 0.9
    deletion_threshold: float = 0.2
    merge_threshold: float = 0.8
    merge_overlap: float = 0.4
    nonneg: bool = True
    noise: float = 0.0
    #: First round with a fluctuating background (None: never), its ring, the most of its sketch, and its bins.
    background_from: int | None = None
    ring_radius: int = 10
    background_rank: int = 300
    background_bins: int = 20
    seed: int = 0

    def share(self, i: int) -> float:
        """The support threshold of round i: fixed, or evenly from one value to another."""
        s = self.support_threshold
        return float(np.linspace(*s, self.rounds)[i]) if isinstance(s, tuple) else s


@dataclass(frozen=True)
class Background:
    """mix (pixel, r, value) and course (r, frame, value)."""

    mix: DataFrame
    course: DataFrame


@dataclass(frozen=True)
class DemixResults:
    """Footprints a, traces c and baseline b of a factored movie u, v, with a background if there is one."""

    u: DataFrame
    v: DataFrame
    a: DataFrame
    c: DataFrame
    b: DataFrame
    mix: DataFrame | None = None
    course: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    def signals(self, only: list[int] | None = None) -> DataFrame:
        """The movie of all signals, or of some."""
        a = self.a if only is None else self.a.where(F.col("comp").isin(only))
        return factors.product(a, self.c)

    def background(self) -> DataFrame | None:
        return background.background_movie(self.mix, self.course) if self.mix is not None else None

    def residual(self) -> DataFrame:
        terms = [(1.0, factors.product(self.u, self.v)), (-1.0, self.signals())]
        if self.mix is not None:
            terms.append((-1.0, self.background()))
        return factors.signed_sum(*terms).join(self.b, "pixel").select("pixel", "frame", (F.col("value") - F.col("b")).alias("value"))

    def roi_averages(self) -> DataFrame:
        """comp, frame and the means over each support of the factored movie, the background and the residual.

        Means of factored movies come from means of their left factors over supports, not from their pixels.
        """
        return roi_of_three(self.u, self.v, self.a, self.c, self.b, self.mix, self.course)

    _tables = ("u", "v", "a", "c", "b", "mix", "course")

    def save(self, path: str) -> None:
        """One table each, absent ones left out, and a note of the rest; a folder that exists is refused."""
        for name in self._tables:
            if (t := getattr(self, name)) is not None:
                t.write.mode("errorifexists").parquet(f"{path}/{name}")
        there = [n for n in self._tables if getattr(self, n) is not None]
        self.u.sparkSession.createDataFrame([(json.dumps({"tables": there, **self.meta}),)], "note string").coalesce(1).write.mode("errorifexists").text(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> DemixResults:
        note = json.loads(spark.read.text(f"{path}/meta").first()[0])
        there = set(note.pop("tables"))
        return DemixResults(*[spark.read.parquet(f"{path}/{n}") if n in there else None for n in DemixResults._tables], note)


def roi_of_three(u, v, a, c, b, mix=None, course=None) -> DataFrame:
    on = a.where("value <> 0").select("pixel", F.col("comp").alias("roi"))
    size = on.groupBy("roi").agg(F.count("*").alias("n"))

    def means(left, right, axis):
        small = on.join(left, "pixel").groupBy("roi", axis).agg(F.sum("value").alias("w"))
        return small.join(right.withColumnRenamed("value", "z"), axis).groupBy("roi", "frame").agg(F.sum(F.col("w") * F.col("z")).alias("value")).join(size, "roi").select("roi", "frame", (F.col("value") / F.col("n")).alias("value"))

    pmd = means(u, v, "comp").withColumnRenamed("value", "pmd")
    signal = means(a, c, "comp").withColumnRenamed("value", "signal")
    base = on.join(b, "pixel").groupBy("roi").agg(F.avg("b").alias("base"))
    out = pmd.join(signal, ["roi", "frame"]).join(base, "roi")
    if mix is not None:
        out = out.join(means(mix, course, "r").withColumnRenamed("value", "background"), ["roi", "frame"])
    else:
        out = out.withColumn("background", F.lit(0.0))
    return out.select(F.col("roi").alias("comp"), "frame", "pmd", "background", (F.col("pmd") - F.col("signal") - F.col("background") - F.col("base")).alias("residual"))


def _by_colour(a: DataFrame) -> list[list[int]]:
    """Components in groups without shared pixels; edges between components come to the driver, not pixels."""
    nodes = sorted(r[0] for r in a.select("comp").distinct().collect())
    colour = graph.greedy_colours([(r["src"], r["dst"]) for r in factors.overlap_edges(a).collect()], nodes)
    return [[n for n in nodes if colour[n] == k] for k in range(max(colour.values(), default=-1) + 1)]


def _alive(a: DataFrame, c: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Both without the components whose footprints (or traces) sum to zero."""
    good = graph.checkpointed((a if by == "a" else c).groupBy("comp").agg(F.sum("value").alias("s")).where("s <> 0").select("comp"))
    return a.join(good, "comp", "left_semi").select("pixel", "comp", "value"), c.join(good, "comp", "left_semi").select("comp", "frame", "value")


def spatial_round(u, v, a, c, b, groups, bg: Background | None) -> DataFrame:
    """All colours in turn. Inner products with the traces are made once; only the footprints change from colour to colour."""
    data = factors.cross(u, factors.gram(v, c, "frame"))
    if bg is not None:
        lost = factors.cross(bg.mix.withColumnRenamed("r", "comp"), factors.gram(bg.course.withColumnRenamed("r", "comp"), c, "frame"))
        data = data.unionByName(lost.withColumn("g", -F.col("g"))).groupBy("pixel", "comp").agg(F.sum("g").alias("g"))
    data = graph.checkpointed(a.select("pixel", "comp").join(data, ["pixel", "comp"], "left"))
    cc = graph.checkpointed(factors.near_gram(c, a))
    sums = graph.checkpointed(c.groupBy("comp").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("norm2")))
    for group in groups:
        mine = a.where(F.col("comp").isin(group))
        own = mine.select("pixel", F.col("comp").alias("kb")).join(cc, "kb").join(a.select("pixel", F.col("comp").alias("ka"), F.col("value").alias("z")), ["pixel", "ka"]).groupBy("pixel", F.col("kb").alias("comp")).agg(F.sum(F.col("value") * F.col("z")).alias("h"))
        new = mine.join(data, ["pixel", "comp"]).join(own, ["pixel", "comp"], "left").join(b, "pixel").join(sums, "comp")
        step = (F.coalesce("g", F.lit(0.0)) - F.coalesce("h", F.lit(0.0)) - F.col("b") * F.col("s")) / F.col("norm2")
        new = new.select("pixel", "comp", F.greatest(F.col("value") + F.coalesce(F.nanvl(step, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("value"))
        a = graph.checkpointed(a.where(~F.col("comp").isin(group)).unionByName(new))
    return a


def temporal_round(u, v, a, c, b, groups, nonneg: bool, bg: Background | None) -> DataFrame:
    """All colours in turn; the data's part is made once, and of the traces only those of neighbours are multiplied."""
    data = factors.gram(a, u, "pixel").select(F.col("ka").alias("comp"), F.col("kb").alias("r"), F.col("value").alias("w")).join(v.select(F.col("comp").alias("r"), "frame", F.col("value").alias("z")), "r").groupBy("comp", "frame").agg(F.sum(F.col("w") * F.col("z")).alias("g"))
    if bg is not None:
        lost = factors.gram(a, bg.mix.withColumnRenamed("r", "comp"), "pixel").select(F.col("ka").alias("comp"), F.col("kb").alias("r"), F.col("value").alias("w")).join(bg.course.withColumnRenamed("value", "z"), "r").groupBy("comp", "frame").agg((-F.sum(F.col("w") * F.col("z"))).alias("g"))
        data = data.unionByName(lost).groupBy("comp", "frame").agg(F.sum("g").alias("g"))
    data = graph.checkpointed(data)
    aa = graph.checkpointed(factors.gram(a, a, "pixel"))
    ab = graph.checkpointed(a.join(b, "pixel").groupBy("comp").agg(F.sum(F.col("value") * F.col("b")).alias("ab"), F.sum(F.col("value") * F.col("value")).alias("norm2")))
    for group in groups:
        mine = c.where(F.col("comp").isin(group))
        own = aa.where(F.col("kb").isin(group)).select(F.col("ka").alias("k"), F.col("kb").alias("comp"), F.col("value").alias("w")).join(c.select(F.col("comp").alias("k"), "frame", F.col("value").alias("z")), "k").groupBy("comp", "frame").agg(F.sum(F.col("w") * F.col("z")).alias("h"))
        new = mine.join(data, ["comp", "frame"]).join(own, ["comp", "frame"]).join(ab, "comp")
        value = F.col("value") + (F.col("g") - F.col("h") - F.col("ab")) / F.col("norm2")
        new = new.select("comp", "frame", (F.greatest(value, F.lit(0.0)) if nonneg else value).alias("value"))
        c = graph.checkpointed(c.where(~F.col("comp").isin(group)).unionByName(new))
    return c


def merge_groups(a: DataFrame, corr: DataFrame, config: DemixConfig) -> DataFrame:
    """id, label: components that share enough of both their correlated pixels, and pixels of their footprints."""
    seen = corr.where(F.col("corr") > config.merge_threshold).select("pixel", F.col("comp").alias("k1"))
    size = seen.groupBy("k1").agg(F.count("*").alias("n1"))
    touch = factors.overlap_edges(a).select(F.col("src").alias("k1"), F.col("dst").alias("k2"))
    # only pairs whose footprints touch are counted over the correlation images
    both = seen.join(touch, "k1").join(seen.select("pixel", F.col("k1").alias("k2")), ["pixel", "k2"]).groupBy("k1", "k2").agg(F.count("*").alias("n"))
    near = both.join(size, "k1").join(size.withColumnsRenamed({"k1": "k2", "n1": "n2"}), "k2").where((F.col("n") / F.col("n1") > config.merge_overlap) & (F.col("n") / F.col("n2") > config.merge_overlap))
    return graph.components(a.select(F.col("comp").alias("id")).distinct(), near.select(F.col("k1").alias("src"), F.col("k2").alias("dst")))


def merged(a: DataFrame, c: DataFrame, groups: DataFrame, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Groups as one component each: the non-negative rank-1 factors of their summed signals, on their joint support.

    The products A (C'x) of a group need its footprints' and traces' Gram tables only, so the alternation runs on
    coefficients: a = A p and c = C q, with p and q of one number for each member.
    """
    g = graph.checkpointed(groups.select(F.col("id").alias("comp"), "label"))
    many = g.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    moved = graph.checkpointed(g.join(many, "label"))
    if moved.isEmpty():
        return a, c
    rows = a.join(moved, "comp").select("label", "comp", "pixel", "value")
    named = moved.select("comp", F.col("label").alias("name"))
    traces = c.join(named, "comp").groupBy("name", "comp").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("t"))

    def fit(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = sorted(right["comp"])
        pixels = np.unique(left["pixel"])
        own = np.zeros((len(pixels), len(names)))
        own[np.searchsorted(pixels, left["pixel"]), np.searchsorted(names, left["comp"])] = left["value"]
        course = np.array([[x["value"] for x in right.loc[right["comp"] == k, "t"].iloc[0]] for k in names])
        frames = [x["frame"] for x in right["t"].iloc[0]]
        p, q = lowrank.rank1_of_factors(own, course, rounds)
        return pd.DataFrame({"label": key[0], "pixels": [pixels.tolist()], "weights": [p.tolist()], "frames": [frames], "trace": [q.tolist()]})

    # one row a component on the right and its pixels on the left; a group is a few neighbouring components
    made = rows.groupBy("label").cogroup(traces.groupBy("name")).applyInPandas(fit, "label long, pixels array<long>, weights array<double>, frames array<long>, trace array<double>")
    made = graph.checkpointed(made.withColumn("label", F.col("label").cast(a.schema["comp"].dataType)))
    new_a = made.select(F.col("label").alias("comp"), F.explode(F.arrays_zip("pixels", "weights")).alias("z")).select(F.col("z.pixels").alias("pixel"), "comp", F.col("z.weights").alias("value")).where("value <> 0")
    new_c = made.select(F.col("label").alias("comp"), F.explode(F.arrays_zip("frames", "trace")).alias("z")).select("comp", F.col("z.frames").alias("frame"), F.col("z.trace").alias("value"))
    stay = lambda t: t.join(moved.select("comp"), "comp", "left_anti")
    return graph.checkpointed(stay(a).select("pixel", "comp", "value").unionByName(new_a)), graph.checkpointed(stay(c).select("comp", "frame", "value").unionByName(new_c))


def low_rank_background(u, v, a, c, b, height: int, width: int, config: DemixConfig, rank: int | None = None) -> tuple[Background, int]:
    """The leading part of U V - A C - b: a basis from its spatial bins, re-fitted at full resolution.

    Traces of the binned residual are R = D U V - D A C - D b; their Gram table over time (bins x bins) comes from the
    components' Gram tables, so only bins x bins numbers reach the driver. Rank: the first with 99 % of the variance.
    """
    n = config.background_bins
    by = F.expr(f"(pixel div {width} div {n}) * {max(1, width // n)} + pixel % {width} div {n}")
    inside = F.expr(f"pixel div {width} < {height // n * n} AND pixel % {width} < {width // n * n}")
    # the residual's factors side by side: components of u, of a (negative), and the constant
    frames = v.select("frame").distinct()
    left = u.select("pixel", F.concat(F.lit("u"), "comp").alias("k"), "value").unionByName(a.select("pixel", F.concat(F.lit("a"), "comp").alias("k"), (-F.col("value")).alias("value"))).unionByName(b.select("pixel", F.lit("b").alias("k"), (-F.col("b")).alias("value")))
    right = v.select(F.concat(F.lit("u"), "comp").alias("k"), "frame", "value").unionByName(c.select(F.concat(F.lit("a"), "comp").alias("k"), "frame", "value")).unionByName(frames.select(F.lit("b").alias("k"), "frame", F.lit(1.0).alias("value")))
    left, right = graph.checkpointed(left), graph.checkpointed(right)
    coarse = left.where(inside).groupBy(by.alias("bin"), "k").agg((F.sum("value") / (n * n)).alias("value"))
    binned = graph.checkpointed(coarse.join(right.withColumnRenamed("value", "z"), "k").groupBy("bin", "frame").agg(F.sum(F.col("value") * F.col("z")).alias("value")))
    gram = factors.gram(binned.withColumnRenamed("bin", "comp"), binned.withColumnRenamed("bin", "comp"), "frame").toPandas()
    names = sorted(set(gram["ka"]))
    dense = np.zeros((len(names), len(names)))
    nth = {k: i for i, k in enumerate(names)}
    dense[gram["ka"].map(nth), gram["kb"].map(nth)] = gram["value"]
    values, vectors = np.linalg.eigh((dense + dense.T) / 2)
    values, vectors = np.maximum(values[::-1], 0)[: config.background_rank], vectors[:, ::-1][:, : config.background_rank]
    if rank is None:
        total = values.sum()
        rank = int(np.argmax(np.cumsum(values) / total >= 0.99)) + 1 if total else 1
    rank = max(1, min(rank, int((values > 0).sum()) or 1))
    scale = np.sqrt(np.where(values[:rank] > 0, values[:rank], 1))
    table = u.sparkSession.createDataFrame([(int(k), r, float(vectors[i, r] / scale[r])) for i, k in enumerate(names) for r in range(rank)], "bin long, r int, w double")
    course = graph.checkpointed(binned.join(table, "bin").groupBy("r", "frame").agg(F.sum(F.col("w") * F.col("value")).alias("value")))
    # full resolution: the residual regressed on the orthonormal courses
    inner = right.withColumnRenamed("value", "z").join(course, "frame").groupBy("k", "r").agg(F.sum(F.col("z") * F.col("value")).alias("w"))
    mix = left.join(inner, "k").groupBy("pixel", "r").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return Background(graph.checkpointed(mix), course), rank


def ring_background(u: DataFrame, bg: Background, config: DemixConfig, width: int) -> Background:
    """Each pixel's mix replaced by its ring's sum times a least-squares weight, then projected on U and back."""
    weights = background.ring_weights(bg.mix, config.ring_radius, width)
    flat = bg.mix.select("r", F.expr(f"CAST(pixel div {width} AS INT)").alias("y"), F.expr(f"CAST(pixel % {width} AS INT)").alias("x"), "value")
    rings = background.ring_of(flat, config.ring_radius).select("r", (F.col("y") * width + F.col("x")).cast("long").alias("pixel"), "ring")
    new = rings.join(weights, "pixel").select("pixel", "r", (F.col("ring") * F.col("weight")).alias("value"))
    inner = u.join(new.withColumnRenamed("value", "z"), "pixel").groupBy("comp", "r").agg(F.sum(F.col("value") * F.col("z")).alias("w"))
    return Background(graph.checkpointed(u.join(inner, "comp").groupBy("pixel", "r").agg(F.sum(F.col("value") * F.col("w")).alias("value"))), bg.course)


def seeds(u: DataFrame, v: DataFrame, image: DataFrame, height: int, width: int, cutoff: float, distance: int = 1, patch: int = 100, threshold: float = 0.3, a: DataFrame | None = None, c: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Footprints of one pixel and their traces: local peaks of a correlation image (y, x, corr), pure ones of each patch.

    Traces are those of U V, less what given signals (a, c) explain at their pixel; a patch's traces are one group.
    """
    peaks = pixel.local_peaks(image, distance, cutoff, height, width)
    placed = peaks.select((F.col("y") * width + F.col("x")).cast("long").alias("pixel"), F.expr(f"y div {patch} * {-(-width // patch)} + x div {patch}").alias("patch"))
    placed = graph.checkpointed(placed)
    trace = factors.product(u.join(placed.select("pixel"), "pixel", "left_semi"), v)
    if a is not None and c is not None:
        trace = factors.signed_sum((1.0, trace), (-1.0, factors.product(a.join(placed.select("pixel"), "pixel", "left_semi"), c)))
    centred = trace.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("pixel")))
    rows = centred.groupBy("pixel").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("t")).join(placed, "pixel").select("patch", "pixel", F.col("t.frame").alias("frames"), F.transform("t", lambda s: F.greatest(s["value"], F.lit(0.0))).alias("trace"))

    def pure(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pixel")
        x = np.array(part["trace"].tolist())
        return part.iloc[lowrank.successive_projection(x[x.sum(axis=1) > 0], threshold)] if (x.sum(axis=1) > 0).all() else part[x.sum(axis=1) > 0].iloc[lowrank.successive_projection(x[x.sum(axis=1) > 0], threshold)]

    kept = graph.checkpointed(rows.groupBy("patch").applyInPandas(pure, rows.schema))
    first = (a.agg(F.max("comp")).first()[0] + 1) if a is not None else 0
    order = {r["pixel"]: i + first for i, r in enumerate(kept.select("pixel").orderBy("pixel").collect())}
    names = u.sparkSession.createDataFrame(list(order.items()), "pixel long, comp int")
    new_a = names.select("pixel", "comp", F.lit(1.0).alias("value"))
    new_c = kept.join(names, "pixel").select("comp", F.explode(F.arrays_zip("frames", "trace")).alias("z")).select("comp", F.col("z.frames").alias("frame"), F.col("z.trace").alias("value"))
    if a is not None and c is not None:
        new_a, new_c = a.select("pixel", "comp", "value").unionByName(new_a), c.select("comp", "frame", "value").unionByName(new_c)
    return graph.checkpointed(new_a), graph.checkpointed(new_c)


def custom_seeds(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame | None = None, rounds: int = 25) -> tuple[DataFrame, DataFrame]:
    """Given footprints with traces: fitted by alternating steps, or given ones scaled; those of no size go."""
    a = graph.checkpointed(a)
    if c is None:
        means = a.where("value <> 0").select("pixel", F.col("comp").alias("roi")).join(u, "pixel").groupBy("roi", "comp").agg(F.avg("value").alias("w"))
        c = means.join(v.withColumnRenamed("value", "z"), "comp").groupBy(F.col("roi").alias("comp"), "frame").agg(F.sum(F.col("w") * F.col("z")).alias("value"))
        c = graph.checkpointed(c.withColumn("value", F.greatest(F.col("value"), F.lit(0.0))))
        groups = _by_colour(a)
        for _ in range(max(1, rounds // 5)):
            c = temporal_round(u, v, a, c, graph.checkpointed(factors.baseline(u, v, a, c)), groups, True, None)
    else:
        c = affine_fit(u, v, a, graph.checkpointed(c), rounds)[0]
    return _alive(a, c, "c")


def affine_fit(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame, rounds: int = 25, nonneg: bool = True) -> tuple[DataFrame, DataFrame]:
    """Given traces scaled, and the baseline, by alternating least squares; all Gram tables are made once.

    Scales are one number a component, so the rounds run on the driver over Gram tables of components.
    """
    au, cv = factors.gram(a, u, "pixel"), factors.gram(c, v, "frame")
    data = {r["ka"]: r["s"] for r in au.withColumnRenamed("value", "w").join(cv.withColumnRenamed("value", "z"), ["ka", "kb"]).groupBy("ka").agg(F.sum(F.col("w") * F.col("z")).alias("s")).collect()}
    aa = factors.gram(a, a, "pixel").withColumnRenamed("value", "w").join(factors.gram(c, c, "frame").withColumnRenamed("value", "z"), ["ka", "kb"]).collect()
    means = {r["comp"]: (r["s"], r["m"]) for r in c.groupBy("comp").agg(F.sum("value").alias("s"), F.avg("value").alias("m")).collect()}
    centre = {r["comp"]: r["s"] for r in a.join(factors.mean_product(u, v), "pixel").groupBy("comp").agg(F.sum(F.col("value") * F.col("mean")).alias("s")).collect()}
    names = sorted(means)
    nth = {k: i for i, k in enumerate(names)}
    both, over = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for r in aa:
        both[nth[r["ka"]], nth[r["kb"]]] = r["w"] * r["z"]
        over[nth[r["ka"]], nth[r["kb"]]] = r["w"]
    total, mean = (np.array([means[k][i] for k in names]) for i in range(2))
    m, base = np.ones(len(names)), np.array([centre.get(k, 0.0) for k in names])
    d = np.array([data.get(k, 0.0) for k in names])
    size = np.diag(both)
    for i in range(rounds):
        flat = base - over @ (m * mean)
        for k in range(len(names)):  # one after the other, so that neighbours see each other's change
            step = (d[k] - flat[k] * total[k] - both[k] @ m) / size[k] if size[k] else 0.0
            m[k] = max(0.0, m[k] + step) if nonneg else m[k] + step
    scales = u.sparkSession.createDataFrame([(k, float(m[nth[k]])) for k in names], f"comp {a.schema['comp'].dataType.simpleString()}, m double")
    scaled = graph.checkpointed(c.join(scales, "comp").select("comp", "frame", (F.col("value") * F.col("m")).alias("value")))
    return scaled, graph.checkpointed(factors.baseline(u, v, a, scaled))


def demix(u: DataFrame, v: DataFrame, a: DataFrame, c: DataFrame, config: DemixConfig = DemixConfig(), shape: tuple[int, int] | None = None) -> DemixResults:
    """Alternating updates by colour; at intervals merges, deletion of uncorrelated components, growing supports, new colours.

    shape: height and width, needed for growing supports and the background.
    """
    u, v, a, c = (graph.checkpointed(x) for x in (u, v, a, c))
    groups = _by_colour(a)
    n_frames = v.select("frame").distinct().count()
    bg, rank = None, None

    def base() -> DataFrame:
        return graph.checkpointed(factors.baseline(u, v, a, c) if bg is None else background.baseline(u, v, a, c, bg.mix, bg.course))

    for i in range(config.rounds):
        b = base()
        if shape and config.background_from is not None and i >= config.background_from:
            low, rank = low_rank_background(u, v, a, c, b, *shape, config, rank)
            bg = ring_background(u, low, config, shape[1])
        a, c = _alive(spatial_round(u, v, a, c, b, groups, bg), c, "a")
        a, c = graph.checkpointed(a), graph.checkpointed(c)
        a, c = _alive(a, temporal_round(u, v, a, c, base(), groups, config.nonneg, bg), "c")
        a, c = graph.checkpointed(a), graph.checkpointed(c)
        if config.update_every and (i + 1) % config.update_every == 0:
            corr = graph.checkpointed(factors.standard_correlation(u, v, c, n_frames, config.noise))
            a, c = merged(a, c, merge_groups(a, corr, config))
            corr = graph.checkpointed(background.residual_correlation(u, v, a, c, n_frames, config.noise))
            good = background.supported(a, corr, config.deletion_threshold)
            a, c = graph.checkpointed(a.join(good, "comp", "left_semi").select("pixel", "comp", "value")), graph.checkpointed(c.join(good, "comp", "left_semi").select("comp", "frame", "value"))
            if shape:
                a = graph.checkpointed(background.widened(a, corr.join(good, "comp", "left_semi"), config.share(i), shape[1]))
            groups = _by_colour(a)
    return DemixResults(u, v, a, c, base(), bg.mix if bg else None, bg.course if bg else None)
