"""Queries of the factor operators, over footprints and traces that follow from the embeddings' movie."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import rounded
from framelake.operators import factors, pixel
from framelake.sources import tables as t

from .sql import A, AC, ALL, B, MAC, UV, r, with_

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


class _Tables:
    """The movie and its factors."""

    def __init__(self, spark, d):
        self.m = t.pixels(t.movie(spark, d))
        self.a, self.u = t.footprints(spark), t.blocks_basis(spark)
        self.c, self.v = t.mean_traces(self.a, self.m), t.mean_traces(self.u, self.m)
        self.b = factors.baseline(self.u, self.v, self.a, self.c)
        self.raw = self.m.withColumnRenamed("v", "value")


def _six(df, *cols):
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


@query(with_(f"{ALL}, {UV}", f"SELECT pixel, frame, {r('value', 'value')} FROM uv"))
def pmd_reconstruct(spark, d):
    x = _Tables(spark, d)
    return _six(factors.product(x.u, x.v), "value")


@query(with_(f"{ALL}, {UV}", f"SELECT pixel, frame, {r('value', 'value')} FROM uv WHERE pixel BETWEEN 10 AND 20 AND frame BETWEEN 5 AND 30"))
def pmd_slice(spark, d):
    x = _Tables(spark, d)
    return _six(factors.product(x.u.where("pixel BETWEEN 10 AND 20"), x.v.where("frame BETWEEN 5 AND 30")), "value")


@query(with_(A, "SELECT pixel, count(*) AS rank FROM a GROUP BY 1"))
def rank_heatmap(spark, d):
    return factors.rank_image(t.footprints(spark))


@query(with_(ALL, f"SELECT comp, frame, {r('sum(value * v)', 'value')} FROM u JOIN mp USING (pixel) GROUP BY 1, 2"))
def project_frames(spark, d):
    x = _Tables(spark, d)
    return _six(factors.project(x.u, x.m), "value")


@query(with_(f"{ALL}, {UV}", f"SELECT pixel, frame, {r('v - value', 'value')} FROM mp JOIN uv USING (pixel, frame)"))
def pmd_residual(spark, d):
    x = _Tables(spark, d)
    return _six(factors.signed_sum((1.0, x.raw), (-1.0, factors.product(x.u, x.v))), "value")


@query(with_(f"{ALL}, {UV}", f"SELECT pixel, {r('stddev_samp(v - value)', 'std')} FROM mp JOIN uv USING (pixel, frame) GROUP BY 1"))
def residual_std(spark, d):
    x = _Tables(spark, d)
    res = factors.signed_sum((1.0, x.raw), (-1.0, factors.product(x.u, x.v)))
    return res.groupBy("pixel").agg(rounded(F.stddev_samp("value")).alias("std"))


@query(with_(f"{ALL}, {UV}", f"SELECT pixel, {r('avg(value)', 'mean')} FROM uv GROUP BY 1"))
def factored_mean(spark, d):
    x = _Tables(spark, d)
    return _six(factors.mean_product(x.u, x.v), "mean")


@query(with_(f"{ALL}, {UV}, n AS (SELECT pixel, frame, value - avg(value) OVER (PARTITION BY pixel) AS d FROM uv), k AS (SELECT comp, frame, value - avg(value) OVER (PARTITION BY comp) AS e FROM c)", f"SELECT pixel, comp, {r('sum(d * e) / sqrt(sum(d * d) * sum(e * e))', 'corr')} FROM n JOIN k USING (frame) GROUP BY 1, 2"))
def std_corr_image(spark, d):
    x = _Tables(spark, d)
    n = x.c.select("frame").distinct().count()
    return _six(factors.standard_correlation(x.u, x.v, x.c, n), "corr")


@query(with_(f"{ALL}, {UV}, n AS (SELECT pixel, frame, value - avg(value) OVER (PARTITION BY pixel) AS d FROM uv), k AS (SELECT comp, frame, value - avg(value) OVER (PARTITION BY comp) AS e FROM c), q AS (SELECT pixel, comp, sum(d * e) / sqrt(sum(d * d) * sum(e * e)) AS corr FROM n JOIN k USING (frame) GROUP BY 1, 2), w AS (SELECT pixel, comp FROM q WHERE corr > 0.05)", "SELECT p.comp AS k1, q.comp AS k2, count(*) AS shared FROM w p JOIN w q ON p.pixel = q.pixel AND p.comp < q.comp GROUP BY 1, 2"))
def overlap_pairs(spark, d):
    x = _Tables(spark, d)
    n = x.c.select("frame").distinct().count()
    w = factors.standard_correlation(x.u, x.v, x.c, n).where("corr > 0.05").select("pixel", F.col("comp").alias("k1"))
    return w.join(w.select("pixel", F.col("k1").alias("k2")), "pixel").where("k1 < k2").groupBy("k1", "k2").agg(F.count("*").alias("shared"))


@query(with_(f"{ALL}, {UV}, n AS (SELECT pixel, frame, value - avg(value) OVER (PARTITION BY pixel) AS d FROM uv), k AS (SELECT comp, frame, value - avg(value) OVER (PARTITION BY comp) AS e FROM c), q AS (SELECT pixel, comp, sum(d * e) / sqrt(sum(d * d) * sum(e * e)) AS corr FROM n JOIN k USING (frame) GROUP BY 1, 2)", "SELECT comp, max(CASE WHEN corr > 0.5 THEN 1 ELSE 0 END) AS kept FROM a JOIN q USING (pixel, comp) GROUP BY 1"))
def deletion_flags(spark, d):
    x = _Tables(spark, d)
    n = x.c.select("frame").distinct().count()
    q = factors.standard_correlation(x.u, x.v, x.c, n)
    return x.a.join(q, ["pixel", "comp"]).groupBy("comp").agg(F.max((F.col("corr") > 0.5).cast("int")).alias("kept"))


@query(with_(f"{ALL}, {UV}, {AC}, {B}", f"SELECT pixel, {r('b', 'b')} FROM b"))
def baseline_update(spark, d):
    return _six(_Tables(spark, d).b, "b")


_GRAMS = "aa AS (SELECT p.comp, q.comp AS k, sum(p.value * q.value) AS w FROM a p JOIN a q ON p.pixel = q.pixel GROUP BY 1, 2), n2 AS (SELECT comp, sum(value * value) AS norm2 FROM a GROUP BY 1)"


@query(with_(f"{ALL}, {UV}, {AC}, {B}, {_GRAMS}, g AS (SELECT comp, frame, sum(a.value * uv.value) AS g FROM a JOIN uv USING (pixel) GROUP BY 1, 2), h AS (SELECT aa.comp, frame, sum(w * c.value) AS h FROM aa JOIN c ON c.comp = aa.k GROUP BY 1, 2), ab AS (SELECT comp, sum(value * b) AS ab FROM a JOIN b USING (pixel) GROUP BY 1)", f"SELECT comp, frame, {r('greatest(c.value + (g - h - ab) / norm2, 0)', 'value')} FROM c JOIN g USING (comp, frame) JOIN h USING (comp, frame) JOIN ab USING (comp) JOIN n2 USING (comp)"))
def hals_temporal_step(spark, d):
    x = _Tables(spark, d)
    return _six(factors.temporal_step(x.u, x.v, x.a, x.c, x.b), "value")


@query(with_(f"{ALL}, {UV}, {AC}, {B}, cc AS (SELECT p.comp AS k, q.comp, sum(p.value * q.value) AS w FROM c p JOIN c q ON p.frame = q.frame GROUP BY 1, 2), g AS (SELECT pixel, comp, sum(uv.value * c.value) AS g FROM uv JOIN c USING (frame) GROUP BY 1, 2), h AS (SELECT a.pixel, cc.comp, sum(a.value * w) AS h FROM a JOIN cc ON cc.k = a.comp GROUP BY 1, 2), s AS (SELECT comp, sum(value) AS s, sum(value * value) AS norm2 FROM c GROUP BY 1)", f"SELECT pixel, comp, {r('greatest(a.value + (g - h - b * s) / norm2, 0)', 'value')} FROM a JOIN g USING (pixel, comp) JOIN h USING (pixel, comp) JOIN b USING (pixel) JOIN s USING (comp)"))
def hals_spatial_step(spark, d):
    x = _Tables(spark, d)
    return _six(factors.spatial_step(x.u, x.v, x.a, x.c, x.b), "value")


@query(with_(A, f"SELECT comp, {r('sum(value * value)', 'norm2')} FROM a GROUP BY 1"))
def footprint_norms(spark, d):
    return _six(factors.squared_norms(t.footprints(spark)), "norm2")


@query(with_(MAC, f"SELECT comp, frame, {r('value / sqrt(sum(value * value) OVER (PARTITION BY comp))', 'value')} FROM c"))
def normalised_traces(spark, d):
    c = _Tables(spark, d).c
    return c.select("comp", "frame", rounded(F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("comp")))).alias("value"))


@query(with_(f"{MAC}, {AC}", f"SELECT pixel, frame, {r('value', 'value')} FROM ac"))
def ac_reconstruct(spark, d):
    x = _Tables(spark, d)
    return _six(factors.product(x.a, x.c), "value")


@query(with_(f"{ALL}, {UV}, {AC}, {B}", f"SELECT pixel, frame, {r('uv.value - ac.value - b', 'value')} FROM uv JOIN ac USING (pixel, frame) JOIN b USING (pixel)"))
def residual_movie(spark, d):
    x = _Tables(spark, d)
    both = factors.signed_sum((1.0, factors.product(x.u, x.v)), (-1.0, factors.product(x.a, x.c)))
    return both.join(x.b, "pixel").select("pixel", "frame", rounded(F.col("value") - F.col("b")).alias("value"))


@query(with_(f"{A}, s AS (SELECT comp, pixel // 8 AS y, pixel % 8 AS x FROM a), n AS (SELECT DISTINCT comp, y + dy AS y, x + dx AS x FROM s, (SELECT unnest([-1, 0, 1]) AS dy) p, (SELECT unnest([-1, 0, 1]) AS dx) q)", "SELECT comp, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM n WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 AND NOT EXISTS (SELECT 1 FROM s WHERE s.comp = n.comp AND s.y = n.y AND s.x = n.x)"))
def contours(spark, d):
    a = t.footprints(spark).selectExpr("comp", "CAST(pixel div 8 AS INT) AS y", "CAST(pixel % 8 AS INT) AS x")
    return pixel.contours(a, 8, 8)


@query(with_(A, f"SELECT comp, {r('sum((pixel // 8) * value) / sum(value)', 'cy')}, {r('sum((pixel % 8) * value) / sum(value)', 'cx')} FROM a GROUP BY 1"))
def centers(spark, d):
    return _six(factors.centres(t.footprints(spark), 8), "cy", "cx")


@query(with_(A, "SELECT comp, min(pixel // 8) AS y0, max(pixel // 8) AS y1, min(pixel % 8) AS x0, max(pixel % 8) AS x1 FROM a GROUP BY 1"))
def bounding_boxes(spark, d):
    return factors.boxes(t.footprints(spark), 8)


@query(with_(MAC, f"SELECT comp, frame, {r('avg(v)', 'mean')} FROM a JOIN mp USING (pixel) GROUP BY 1, 2"))
def roi_averages(spark, d):
    x = _Tables(spark, d)
    return _six(factors.roi_averages(x.a, x.raw), "mean")


_BR = "p AS (SELECT comp, max(abs(value)) AS p FROM a GROUP BY 1), q AS (SELECT comp, max(abs(value)) AS q FROM c GROUP BY 1), br AS (SELECT comp, p * q AS brightness, row_number() OVER (ORDER BY p * q DESC, comp) AS rank FROM p JOIN q USING (comp))"


@query(with_(f"{MAC}, {_BR}", f"SELECT comp, {r('brightness', 'brightness')}, CAST(rank AS INTEGER) AS rank FROM br"))
def brightness_order(spark, d):
    x = _Tables(spark, d)
    return _six(factors.brightness(x.a, x.c), "brightness")


@query(with_(f"{MAC}, {_BR}", "SELECT comp, CAST(least(3, (rank - 1) * 4 // (SELECT count(*) FROM br)) AS INTEGER) AS quantile FROM br"))
def brightness_quantiles(spark, d):
    x = _Tables(spark, d)
    br = factors.brightness(x.a, x.c).withColumn("n", F.count("*").over(Window.partitionBy()))
    return br.select("comp", F.least(F.lit(3), F.expr("(rank - 1) * 4 div n")).cast("int").alias("quantile"))


@query(with_(A, "SELECT p.comp AS src, q.comp AS dst, count(*) AS shared FROM a p JOIN a q ON p.pixel = q.pixel AND p.comp < q.comp GROUP BY 1, 2"))
def component_graph_edges(spark, d):
    return factors.overlap_edges(t.footprints(spark))


@query(with_(A, f"SELECT p.comp AS ka, q.comp AS kb, {r('sum(p.value * q.value) / sqrt(max(n.s) * max(o.s))', 'cosine')} FROM a p JOIN a q ON p.pixel = q.pixel JOIN (SELECT comp, sum(value * value) AS s FROM a GROUP BY 1) n ON n.comp = p.comp JOIN (SELECT comp, sum(value * value) AS s FROM a GROUP BY 1) o ON o.comp = q.comp GROUP BY 1, 2"))
def footprint_cosines(spark, d):
    a = t.footprints(spark)
    return _six(factors.cosine(a, a, "pixel"), "cosine")


_COS = "SELECT p.comp, max(s) AS best FROM (SELECT p.comp, q.comp AS o, sum(p.value * q.value) / sqrt(max(n.s) * max(k.s)) AS s FROM {l} p JOIN {r} q ON p.{x} = q.{x} JOIN (SELECT comp, sum(value * value) AS s FROM {l} GROUP BY 1) n ON n.comp = p.comp JOIN (SELECT comp, sum(value * value) AS s FROM {r} GROUP BY 1) k ON k.comp = q.comp GROUP BY 1, 2) p GROUP BY 1"


@query(with_(f"{ALL}, sp AS ({_COS.format(l='a', r='u', x='pixel')}), tm AS ({_COS.format(l='c', r='z', x='frame')})", "SELECT DISTINCT a.comp FROM a LEFT JOIN sp ON sp.comp = a.comp LEFT JOIN tm ON tm.comp = a.comp WHERE coalesce(sp.best, 0) < 0.5 AND coalesce(tm.best, 0) < 0.6"))
def signal_matching(spark, d):
    x = _Tables(spark, d)
    return factors.unmatched(x.a, x.c, x.u, x.v, 0.5, 0.6)


@query(with_(A, f"SELECT comp, pixel // 8 // 3 AS by, pixel % 8 // 3 AS bx, {r('sum(value) / 9', 'value')} FROM a WHERE pixel // 8 < 6 AND pixel % 8 < 6 GROUP BY 1, 2, 3"))
def sparse_downsample(spark, d):
    a = t.footprints(spark).where("pixel div 8 < 6 AND pixel % 8 < 6")
    return a.groupBy("comp", F.expr("pixel div 8 div 3").alias("by"), F.expr("pixel % 8 div 3").alias("bx")).agg(rounded(F.sum("value") / 9).alias("value"))


@query(with_(f"{A}, s AS (SELECT comp, sum(value) AS s FROM a GROUP BY 1)", f"SELECT pixel, comp, {r('value / s', 'weight')}, CAST(1 AS DOUBLE) AS mask FROM a JOIN s USING (comp)"))
def footprint_import(spark, d):
    a = t.footprints(spark)
    return a.select("pixel", "comp", rounded(F.col("value") / F.sum("value").over(Window.partitionBy("comp"))).alias("weight"), F.lit(1.0).alias("mask"))


_POST = "f AS (SELECT comp, frame, value AS x, avg(value) OVER (PARTITION BY comp ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mu FROM c), g AS (SELECT *, (x - mu) * (x - mu) AS total FROM f), s AS (SELECT comp, quantile_cont(total, 0.3) AS noise FROM g GROUP BY 1)"


@query(with_(f"{MAC}, {_POST}", f"SELECT comp, frame, {r('CASE WHEN greatest(total, noise) = 0 THEN x ELSE noise / greatest(total, noise) * mu + (1 - noise / greatest(total, noise)) * x END', 'value')} FROM g JOIN s USING (comp)"))
def posterior_mix(spark, d):
    c = _Tables(spark, d).c.withColumnRenamed("value", "x")
    w = Window.partitionBy("comp").orderBy("frame").rowsBetween(-1, 1)
    g = c.withColumn("mu", F.avg("x").over(w)).withColumn("total", (F.col("x") - F.col("mu")) * (F.col("x") - F.col("mu")))
    noise = g.groupBy("comp").agg(F.expr("percentile(total, 0.3)").alias("noise"))
    return _six(factors.posterior_mix(g, noise), "value")


def _trace_arrays(c):
    sorted_ = F.array_sort(F.collect_list(F.struct("frame", "value")))
    return c.groupBy("comp").agg(F.transform(sorted_, lambda s: s["value"]).alias("trace"))


_STARTS = "st AS (SELECT unnest([0, 20, 40, 60]) AS start)"


@query(with_(f"{MAC}, {_STARTS}", f"SELECT comp, start, CAST(frame - start AS INTEGER) AS i, {r('value', 'value')} FROM c JOIN st ON frame >= start AND frame < start + 40"))
def window_snippets(spark, d):
    s = factors.snippets(_trace_arrays(_Tables(spark, d).c.where("frame < 100")), 100, 40, 20)
    return s.select("comp", "start", F.posexplode("snippet").alias("i", "value")).withColumn("value", rounded(F.col("value")))


@query(with_(f"{MAC}, {_STARTS}", f"SELECT comp, CAST(frame AS INTEGER) AS frame, {r('avg(value)', 'value')} FROM c JOIN st ON frame >= start AND frame < start + 40 GROUP BY 1, 2"))
def overlap_average(spark, d):
    return _six(factors.overlap_average(factors.snippets(_trace_arrays(_Tables(spark, d).c.where("frame < 100")), 100, 40, 20)), "value")


#: Starts over the whole movie, the last window anchored to its end.
_ALL_STARTS = "n AS (SELECT greatest(max(frame) + 1 - 40, 0) AS last FROM c), st AS (SELECT CAST(unnest(list_distinct(list_append(range(0, last + 1, 20), last))) AS INTEGER) AS start FROM n)"


@query(with_(f"{MAC}, {_ALL_STARTS}", f"SELECT comp, start, CAST(frame - start AS INTEGER) AS i, {r('value', 'value')} FROM c JOIN st ON frame >= start AND frame < start + 40"))
def window_snippets_movie(spark, d):
    s = factors.snippets(_trace_arrays(_Tables(spark, d).c), None, 40, 20)
    return s.select("comp", "start", F.posexplode("snippet").alias("i", "value")).withColumn("value", rounded(F.col("value")))


@query(with_(f"{MAC}, {_ALL_STARTS}", f"SELECT comp, CAST(frame AS INTEGER) AS frame, {r('avg(value)', 'value')} FROM c JOIN st ON frame >= start AND frame < start + 40 GROUP BY 1, 2"))
def overlap_average_movie(spark, d):
    return _six(factors.overlap_average(factors.snippets(_trace_arrays(_Tables(spark, d).c), None, 40, 20)), "value")


@query(with_(f"{ALL}, {UV}", f"SELECT {r('quantile_cont(s, 0.1)', 'noise')} FROM (SELECT pixel, stddev_samp(value) AS s FROM uv GROUP BY 1) q"))
def robust_noise(spark, d):
    x = _Tables(spark, d)
    std = factors.product(x.u, x.v).groupBy("pixel").agg(F.stddev_samp("value").alias("s"))
    return std.agg(rounded(F.expr("percentile(s, 0.1)")).alias("noise"))


_COLOR = "k AS (SELECT comp, value - min(value) OVER (PARTITION BY comp) AS value, frame FROM c), rgb AS (SELECT DISTINCT comp, CAST((comp * 37 + 11) % 100 AS DOUBLE) AS cr, CAST((comp * 53 + 29) % 100 AS DOUBLE) AS cg, CAST((comp * 71 + 47) % 100 AS DOUBLE) AS cb FROM a), nz AS (SELECT comp, cr / (cr + cg + cb) AS cr, cg / (cr + cg + cb) AS cg, cb / (cr + cg + cb) AS cb FROM rgb)"


@query(with_(f"{MAC}, {_COLOR}", f"SELECT pixel, frame, {r('sum(a.value * k.value * cr)', 'red')}, {r('sum(a.value * k.value * cg)', 'green')}, {r('sum(a.value * k.value * cb)', 'blue')} FROM a JOIN k USING (comp) JOIN nz USING (comp) GROUP BY 1, 2"))
def colour_movie(spark, d):
    x = _Tables(spark, d)
    k = x.c.withColumn("w", F.col("value") - F.min("value").over(Window.partitionBy("comp"))).select("comp", "frame", "w")
    rgb = {n: ((F.col("comp") * p + q) % 100).cast("double") for n, p, q in (("red", 37, 11), ("green", 53, 29), ("blue", 71, 47))}
    total = rgb["red"] + rgb["green"] + rgb["blue"]
    return x.a.join(k, "comp").groupBy("pixel", "frame").agg(*[rounded(F.sum(F.col("value") * F.col("w") * v / total)).alias(n) for n, v in rgb.items()])
