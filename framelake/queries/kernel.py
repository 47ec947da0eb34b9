"""Queries of plans with NumPy kernels; their truth is in the tests, as SQL cannot state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import rounded
from framelake.kernels import images
from framelake.operators import factors
from framelake.plans import demix as demixing
from framelake.plans import movies
from framelake.sources import tables as t


def _frames(spark, d):
    return movies.as_frames(t.movie(spark, d), t.SIDE, t.SIDE)


def rigid_register(spark, d):
    frames = _frames(spark, d)
    return movies.register_rigid(frames, movies.template_of(frames, passes=0), (2, 2)).select("frame", rounded(F.col("dy"), 3).alias("dy"), rounded(F.col("dx"), 3).alias("dx"))


def pwrigid_register(spark, d):
    frames = _frames(spark, d)
    return movies.register_piecewise(frames, movies.template_of(frames, passes=0), (4, 4), (2, 2), (1, 1)).select("frame", "field")


def inpaint_frames(spark, d):
    import numpy as np

    mask = np.zeros((t.SIDE, t.SIDE), bool)
    mask[2:4, 3:6] = True
    return movies.mapped(_frames(spark, d), lambda x: images.inpaint(x, mask)).select("frame", "data")


def pmd_blocks(spark, d):
    made = movies.compress(t.movie(spark, d), t.SIDE, t.SIDE, (4, 4), 3)
    return made.select("comp", "block", F.size("trace").alias("n_frames"), rounded(F.aggregate("trace", F.lit(0.0), lambda s, x: s + x * x), 4).alias("energy"))


def butterworth_highpass(spark, d):
    c = t.mean_traces(t.footprints(spark), t.pixels(t.movie(spark, d)))
    arrays = c.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda s: s["value"]).alias("trace"))
    return movies.filtered_traces(arrays, 5.0, 100.0)


def demix_loop(spark, d):
    m = t.pixels(t.movie(spark, d))
    a, u = t.footprints(spark), t.blocks_basis(spark)
    out = demixing.demix(u, t.mean_traces(u, m), a, t.mean_traces(a, m), demixing.DemixConfig(rounds=1, update_every=1))
    return factors.brightness(out.a, out.c).select("comp", rounded(F.col("brightness"), 4).alias("brightness"))


QUERIES = {f.__name__: f for f in (rigid_register, pwrigid_register, inpaint_frames, pmd_blocks, butterworth_highpass, demix_loop)}
