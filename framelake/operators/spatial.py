"""Operators on images, masks and regions: borders, gradients, growth, regions, clusters of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import EIGHT, HALF, at_offsets
from framelake.operators import graph

PIXEL = ["y", "x"]


def border_mask(image: DataFrame, height: int, width: int, border: int = 3) -> DataFrame:
    """weight 0 within `border` pixels of an edge, 1 elsewhere."""
    inside = F.col("y").between(border, height - border - 1) & F.col("x").between(border, width - border - 1)
    return image.select(*PIXEL, F.when(inside, 1.0).otherwise(0.0).alias("weight"))


def alignment_loss(movie: DataFrame, template: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """frame, loss: weighted squared differences from a template (y, x, template) over the number of pixels."""
    near = movie.join(template, PIXEL)
    near = near.join(weights.select(*PIXEL, "weight"), PIXEL) if weights is not None else near.withColumn("weight", F.lit(1.0))
    diff = F.col("template") - F.col("v")
    return near.groupBy("frame").agg((F.sum(F.col("weight") * diff * diff) / F.count("*")).alias("loss"))


def gradient_basis(image: DataFrame, height: int, width: int, column: str = "mean") -> DataFrame:
    """y, x, gx, gy: central differences of an image (0 at the edges), each made orthogonal to the image."""
    near = at_offsets(image.select(*PIXEL, F.col(column).alias("f")), [(0, 1), (0, -1), (1, 0), (-1, 0)])
    term = lambda dy, dx: F.sum(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("f")))
    sides = near.groupBy(*PIXEL).agg(term(0, 1).alias("left"), term(0, -1).alias("right"), term(1, 0).alias("above"), term(-1, 0).alias("below"))
    own = image.select(*PIXEL, F.col(column).alias("f")).join(sides, PIXEL)
    half = lambda a, b: F.coalesce((F.col(a) - F.col(b)) / 2, F.lit(0.0))
    raw = own.select(*PIXEL, "f", half("right", "left").alias("rx"), half("below", "above").alias("ry"))
    dots = raw.agg(F.sum(F.col("f") * F.col("f")).alias("ff"), F.sum(F.col("f") * F.col("rx")).alias("fx"), F.sum(F.col("f") * F.col("ry")).alias("fy")).first()
    free = lambda r, d: F.col(r) - F.lit((dots[d] or 0.0) / (dots["ff"] or 1.0)) * F.col("f")
    return raw.select(*PIXEL, free("rx", "fx").alias("gx"), free("ry", "fy").alias("gy"))


def gradient_shifts(movie: DataFrame, basis: DataFrame) -> DataFrame:
    """frame, sx, sy: least squares of each frame on the two gradients, by their 2 x 2 normal equations."""
    g = basis.agg(*[F.sum(F.col(a) * F.col(b)).alias(n) for a, b, n in (("gx", "gx", "xx"), ("gx", "gy", "xy"), ("gy", "gy", "yy"))]).first()
    det = g["xx"] * g["yy"] - g["xy"] ** 2
    dots = movie.join(basis, PIXEL).groupBy("frame").agg(F.sum(F.col("v") * F.col("gx")).alias("px"), F.sum(F.col("v") * F.col("gy")).alias("py"))
    return dots.select("frame", ((g["yy"] * F.col("px") - g["xy"] * F.col("py")) / det).alias("sx"), ((g["xx"] * F.col("py") - g["xy"] * F.col("px")) / det).alias("sy"))


def gradient_corrected(movie: DataFrame, basis: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """The movie (or a target movie) less what its gradients explain."""
    shifts = gradient_shifts(movie, basis)
    return (target if target is not None else movie).join(basis, PIXEL).join(shifts, "frame").select("frame", *PIXEL, (F.col("v") - F.col("sx") * F.col("gx") - F.col("sy") * F.col("gy")).alias("v"))


def grid_edges(height: int, width: int) -> int:
    """Pairs of neighbouring pixels, diagonals too, in a grid."""
    return height * (width - 1) + width * (height - 1) + 2 * (height - 1) * (width - 1)


def adjacency(image: DataFrame, width: int) -> DataFrame:
    """src < dst: neighbouring pixels that are both there."""
    pixel = F.col("y") * width + F.col("x")
    near = at_offsets(image.select(*PIXEL, pixel.cast("long").alias("src")), HALF)
    own = image.select(*PIXEL, pixel.cast("long").alias("dst"))
    return near.join(own, PIXEL).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def grown(seeds: DataFrame, allowed: DataFrame, steps: int = 30) -> DataFrame:
    """comp, y, x reached from the seeds (comp, y, x) in at most so many steps of 8 neighbours through allowed ones.

    Each step is an equi-join; it ends early when nothing is added.
    """
    now = graph.checkpointed(seeds.join(allowed, ["comp", *PIXEL], "left_semi").select("comp", *PIXEL).distinct())
    edge = now
    for _ in range(steps):
        near = at_offsets(edge, EIGHT).select("comp", *PIXEL).distinct()
        edge = graph.checkpointed(near.join(allowed, ["comp", *PIXEL], "left_semi").join(now, ["comp", *PIXEL], "left_anti"))
        if edge.isEmpty():
            break
        now = graph.checkpointed(now.unionByName(edge))
    return now


def regions(mask: DataFrame, width: int) -> DataFrame:
    """label, y, x: 8-connected regions of a mask's pixels (y, x), named by their smallest pixel."""
    nodes = mask.select((F.col("y") * width + F.col("x")).cast("long").alias("id"))
    found = graph.components(nodes, adjacency(mask, width))
    return found.select("label", F.expr(f"CAST(id div {width} AS INT)").alias("y"), F.expr(f"CAST(id % {width} AS INT)").alias("x"))


def region_table(found: DataFrame) -> DataFrame:
    """label, area, box and centroid of regions (label, y, x)."""
    return found.groupBy("label").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def clustered(points: DataFrame, reach: float, least: int) -> DataFrame:
    """id, cluster (null: noise) of points (id, y, x) by density: dense points within reach are one cluster.

    Points meet in cells of the reach's size and their neighbours, an equi-join. A point near several clusters joins
    that of the smallest name.
    """
    cell = points.withColumns({"cy": F.floor(F.col("y") / reach), "cx": F.floor(F.col("x") / reach)})
    around = at_offsets(cell, [(0, 0), *EIGHT], "cy", "cx").select("cy", "cx", F.col("id").alias("src"), F.col("y").alias("py"), F.col("x").alias("px"))
    gap = (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")) + (F.col("x") - F.col("px")) * (F.col("x") - F.col("px"))
    near = graph.checkpointed(cell.join(around, ["cy", "cx"]).where(gap <= reach * reach).select(F.col("id").alias("dst"), "src"))
    dense = near.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("dst").alias("id"))
    link = near.join(dense.withColumnRenamed("id", "dst"), "dst", "left_semi").join(dense.withColumnRenamed("id", "src"), "src", "left_semi")
    names = graph.components(dense, link.where("src < dst"))
    reached = near.join(names.withColumnsRenamed({"id": "src", "label": "name"}), "src").groupBy(F.col("dst").alias("id")).agg(F.min("name").alias("border"))
    return points.select("id").join(names, "id", "left").join(reached, "id", "left").select("id", F.coalesce("label", "border").alias("cluster"))
