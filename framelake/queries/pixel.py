"""Queries of the per-pixel and per-frame operators over the embeddings' movie."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import HALF, rounded
from framelake.kernels.images import block_starts, gaussian_highpass, pyramid_weights
from framelake.operators import graph, pixel
from framelake.sources import tables as t

from .sql import M, r, with_

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _six(df, *cols):
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


@query(with_(M, f"SELECT frame, y, x, {r('v', 'v')} FROM m WHERE frame >= 10 AND frame < 40 AND y >= 1 AND y < 6 AND x >= 2 AND x < 8"))
def frame_slice(spark, d):
    return _six(pixel.frames(t.movie(spark, d), 10, 40, (1, 6), (2, 8)), "v")


@query(with_(M, f"SELECT frame, y, x, {r('v - avg(v) OVER (PARTITION BY y, x)', 'v')} FROM m"))
def offset_subtraction(spark, d):
    m = t.movie(spark, d)
    return _six(pixel.minus_image(m, pixel.mean_image(m), "mean"), "v").select("frame", "y", "x", "v")


@query(with_(M, "SELECT y, x, max(CASE WHEN v > 0.35 THEN 1 ELSE 0 END) AS saturated FROM m GROUP BY 1, 2"))
def saturation_mask(spark, d):
    return pixel.saturated(t.movie(spark, d), 0.35)


_PIX = "g AS (SELECT CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x FROM (SELECT unnest(range(0, 8)) AS a) p, (SELECT unnest(range(0, 8)) AS b) q)"


@query(with_(f"{M}, {_PIX}, mask AS (SELECT y, x FROM m GROUP BY 1, 2 HAVING avg(v) > 0.01)", "SELECT DISTINCT g.y, g.x FROM g JOIN mask k ON (g.y - k.y) * (g.y - k.y) + (g.x - k.x) * (g.x - k.x) <= 4"))
def dilated_mask(spark, d):
    return pixel.dilated(pixel.mean_image(t.movie(spark, d)).where("mean > 0.01"), 2, 8, 8)


_SHIFTS = "s AS (SELECT frame, 4 * max(CASE WHEN y = 0 AND x = 0 THEN v END) AS dy, 4 * max(CASE WHEN y = 0 AND x = 1 THEN v END) AS dx FROM m GROUP BY 1), lim AS (SELECT abs(floor(least(min(dy), 0))) AS ny, ceil(greatest(max(dy), 0)) AS py, abs(floor(least(min(dx), 0))) AS nx, ceil(greatest(max(dx), 0)) AS px FROM s)"


@query(with_(f"{M}, {_PIX}, {_SHIFTS}", "SELECT y, x, CASE WHEN y >= py AND y < 8 - ny AND x >= px AND x < 8 - nx THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS weight FROM g, lim"))
def border_weight_mask(spark, d):
    m = t.movie(spark, d)
    at = lambda x: 4 * F.max(F.when((F.col("y") == 0) & (F.col("x") == x), F.col("v")))
    return pixel.border_weights(pixel.mean_image(m), m.groupBy("frame").agg(at(0).alias("dy"), at(1).alias("dx")), 8, 8)


@query(with_(M, f"SELECT y, x, {r('median(v)', 'template')} FROM m WHERE frame < 500 GROUP BY 1, 2"))
def median_template(spark, d):
    return _six(pixel.median_image(t.movie(spark, d)), "template")


_MAD = "q AS (SELECT y, x, quantile_disc(v, 0.5) AS med FROM m GROUP BY 1, 2), dv AS (SELECT y, x, quantile_disc(abs(v - med), 0.5) AS mad FROM m JOIN q USING (y, x) GROUP BY 1, 2), k AS (SELECT frame, y, x, v FROM m JOIN q USING (y, x) JOIN dv USING (y, x) WHERE abs(v - med) >= 1.0 * mad)"


@query(with_(f"{M}, {_MAD}", f"SELECT frame, y, x, {r('v', 'v')} FROM k"))
def mad_threshold(spark, d):
    return _six(pixel.mad_kept(t.movie(spark, d), 1.0), "v")


@query(with_(f"{M}, q AS (SELECT y, x, median(v) AS med FROM m GROUP BY 1, 2), dv AS (SELECT y, x, median(abs(v - med)) AS mad FROM m JOIN q USING (y, x) GROUP BY 1, 2)", f"SELECT frame, y, x, {r('greatest(v - med - 2 * mad, 0)', 'v')} FROM m JOIN q USING (y, x) JOIN dv USING (y, x)"))
def spike_mad(spark, d):
    return _six(pixel.spikes(t.movie(spark, d), 2.0), "v")


_NOISE = "w AS (SELECT *, v - avg(v) OVER (PARTITION BY y, x) AS d, avg(v) OVER (PARTITION BY y, x) AS mu FROM m), l AS (SELECT *, lag(d) OVER (PARTITION BY y, x ORDER BY frame) AS p FROM w), n AS (SELECT y, x, max(mu) AS mean, CASE WHEN avg(d * d) - avg(d * p) < 1e-8 THEN 1.0 ELSE sqrt(greatest(avg(d * d) - avg(d * p), 0)) END AS std FROM l GROUP BY 1, 2)"


@query(with_(f"{M}, {_NOISE}", f"SELECT y, x, {r('mean', 'mean')}, {r('std', 'std')} FROM n"))
def pixel_mean_noise_std(spark, d):
    return _six(pixel.noise_image(t.movie(spark, d)), "mean", "std")


@query(with_(f"{M}, {_NOISE}", f"SELECT frame, y, x, {r('(v - mean) / std', 'v')} FROM m JOIN n USING (y, x)"))
def standardised_frames(spark, d):
    return _six(pixel.standardised(t.movie(spark, d)), "v")


_KERNEL = gaussian_highpass(1.0, 1.0)
_TAPS = ", ".join(f"({i - 3}, {j - 3}, CAST({float(k)!r} AS DOUBLE))" for i, row in enumerate(_KERNEL.tolist()) for j, k in enumerate(row))
_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query(with_(f"{M}, {_PIX}, taps(dy, dx, k) AS (VALUES {_TAPS}), w AS (SELECT g.y AS ty, g.x AS tx, {_MIRROR.format('g.y + dy')} AS y, {_MIRROR.format('g.x + dx')} AS x, k FROM g, taps)", f"SELECT frame, ty AS y, tx AS x, {r('sum(v * k)', 'v')} FROM w JOIN m USING (y, x) GROUP BY 1, 2, 3"))
def highpass_filter_frames(spark, d):
    return _six(pixel.convolved(t.movie(spark, d), _KERNEL.tolist(), 8, 8), "v")


@query(with_(M, f"SELECT frame // 7 AS bin, y, x, {r('avg(v)', 'v')} FROM m GROUP BY 1, 2, 3"))
def temporal_downsample(spark, d):
    return _six(pixel.time_binned(t.movie(spark, d), 7), "v")


@query(with_(M, f"SELECT frame, y // 3 AS by, x // 3 AS bx, {r('avg(v)', 'v')} FROM m WHERE y < 6 AND x < 6 GROUP BY 1, 2, 3"))
def spatial_downsample(spark, d):
    out = _six(pixel.space_binned(t.movie(spark, d), 3, 8, 8), "v")
    return out.withColumns({"by": F.col("by").cast("int"), "bx": F.col("bx").cast("int")})


_TR = "tr AS (SELECT y * 8 + x AS comp, frame, v AS value FROM m), s AS (SELECT *, lag(value) OVER w + lead(value) OVER w - 2 * value AS d2 FROM tr WINDOW w AS (PARTITION BY comp ORDER BY frame))"


@query(with_(f"{M}, {_TR}", f"SELECT comp, {r('avg(abs(d2)) / avg(abs(value))', 'roughness')} FROM s GROUP BY 1"))
def temporal_roughness(spark, d):
    traces = t.movie(spark, d).select((F.col("y") * 8 + F.col("x")).alias("comp"), "frame", F.col("v").alias("value"))
    return _six(pixel.temporal_roughness(traces, "comp", "value"), "roughness")


_SR = "o(dy, dx, k) AS (VALUES (1, 0, 1), (0, 1, 1), (1, 1, 2)), s AS (SELECT b.frame, sum(k * abs(b.v - a.v)) / sum(k) AS top FROM m a JOIN o ON TRUE JOIN m b ON b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1), l AS (SELECT frame, avg(abs(v)) AS low FROM m GROUP BY 1)"


@query(with_(f"{M}, {_SR}", f"SELECT frame, {r('top / low', 'roughness')} FROM s JOIN l USING (frame)"))
def spatial_roughness(spark, d):
    return _six(pixel.spatial_roughness(t.movie(spark, d)), "roughness")


_DEC = "dec AS (SELECT y AS block, frame AS comp, max(v) > 0.2 AS ok FROM m GROUP BY 1, 2), f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY block ORDER BY comp ROWS 1 PRECEDING) AS bad FROM dec), h AS (SELECT *, coalesce(sum(CASE WHEN bad = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY comp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM f)"


@query(with_(f"{M}, {_DEC}", "SELECT block, comp, ok FROM h WHERE hits = 0"))
def failure_cut(spark, d):
    dec = t.movie(spark, d).groupBy(F.col("y").alias("block"), F.col("frame").alias("comp")).agg((F.max("v") > 0.2).alias("ok"))
    return pixel.failure_cut(dec, 2)


_CORR = "dd AS (SELECT frame, y, x, v - avg(v) OVER (PARTITION BY y, x) AS d FROM {src}), nn AS (SELECT y, x, sum(d * d) AS n2 FROM dd GROUP BY 1, 2), o(dy, dx) AS (VALUES (0, 1), (1, 0), (1, 1), (1, -1)), pr AS (SELECT a.y AS y0, a.x AS x0, b.y AS y1, b.x AS x1, sum(a.d * b.d) AS s FROM dd a JOIN o ON TRUE JOIN dd b ON b.frame = a.frame AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4), cc AS (SELECT pr.*, CASE WHEN p.n2 < 1e-12 OR q.n2 < 1e-12 THEN 0 ELSE s / sqrt(p.n2 * q.n2) END AS c FROM pr JOIN nn p ON p.y = y0 AND p.x = x0 JOIN nn q ON q.y = y1 AND q.x = x1), ends AS (SELECT y0 AS y, x0 AS x, c FROM cc UNION ALL SELECT y1, x1, c FROM cc), img AS (SELECT y, x, avg(c) AS corr FROM ends GROUP BY 1, 2)"


@query(with_(f"{M}, {_MAD}, {_CORR.format(src='k')}", f"SELECT y, x, {r('corr', 'corr')} FROM img"))
def local_mad_corr_image(spark, d):
    return _six(pixel.neighbour_correlation(pixel.mad_kept(t.movie(spark, d), 1.0)), "corr")


@query(with_(f"{M}, {_CORR.format(src='m')}", f"SELECT y, x, {r('corr', 'corr')} FROM img"))
def local_corr_image(spark, d):
    return _six(pixel.neighbour_correlation(t.movie(spark, d)), "corr")


@query(with_(f"{M}, {_CORR.format(src='m')}", f"SELECT i.y, i.x, {r('i.corr', 'corr')} FROM img i WHERE i.corr > -1 AND i.y BETWEEN 1 AND 6 AND i.x BETWEEN 1 AND 6 AND NOT EXISTS (SELECT 1 FROM img j WHERE abs(j.y - i.y) <= 1 AND abs(j.x - i.x) <= 1 AND j.corr > i.corr)"))
def local_peaks(spark, d):
    return _six(pixel.local_peaks(pixel.neighbour_correlation(t.movie(spark, d)), 1, -1.0, 8, 8), "corr")


@query(with_(f"{M}, {_CORR.format(src='m')}, pk AS (SELECT i.y, i.x FROM img i WHERE i.corr > -1 AND i.y BETWEEN 1 AND 6 AND i.x BETWEEN 1 AND 6 AND NOT EXISTS (SELECT 1 FROM img j WHERE abs(j.y - i.y) <= 1 AND abs(j.x - i.x) <= 1 AND j.corr > i.corr))", "SELECT CAST(y * 8 + x AS BIGINT) AS pixel, CAST(row_number() OVER (ORDER BY y, x) - 1 AS INTEGER) AS comp, CAST(1 AS DOUBLE) AS value FROM pk"))
def seed_footprints(spark, d):
    peaks = pixel.local_peaks(pixel.neighbour_correlation(t.movie(spark, d)), 1, -1.0, 8, 8)
    return peaks.select((F.col("y") * 8 + F.col("x")).cast("long").alias("pixel"), (F.row_number().over(Window.orderBy("y", "x")) - 1).alias("comp"), F.lit(1.0).alias("value"))


@query(with_(f"{M}, {_CORR.format(src='m')}, e AS (SELECT y0 * 8 + x0 AS s, y1 * 8 + x1 AS t FROM cc WHERE c > 0.05), e2 AS (SELECT s, t FROM e UNION ALL SELECT t, s FROM e), ids AS (SELECT CAST(unnest(range(0, 64)) AS BIGINT) AS id)".replace("WITH", ""), "SELECT id, label FROM (WITH RECURSIVE reach(id, other) AS (SELECT id, id FROM ids UNION SELECT reach.id, e2.t FROM reach JOIN e2 ON e2.s = reach.other) SELECT id, min(other) AS label FROM reach GROUP BY 1) z"))
def superpixel_components(spark, d):
    m = t.movie(spark, d)
    centred = m.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy("y", "x")))
    norm = centred.groupBy("y", "x").agg(F.sum(F.col("d") * F.col("d")).alias("n2"))
    full = centred.join(norm, ["y", "x"]).select("frame", "y", "x", (F.col("d") / F.sqrt("n2")).alias("z"))
    from framelake.functions import at_offsets

    near = at_offsets(full, HALF).withColumnsRenamed({"z": "w"}).join(full, ["frame", "y", "x"]).groupBy("y", "x", "dy", "dx").agg(F.sum(F.col("z") * F.col("w")).alias("c")).where("c > 0.05")
    edges = near.selectExpr("CAST(y * 8 + x AS BIGINT) AS src", "CAST((y - dy) * 8 + x - dx AS BIGINT) AS dst")
    return graph.components(spark.range(64), edges)


@query(with_(f"{M}, dd AS (SELECT frame, y, x, v - avg(v) OVER (PARTITION BY y, x) AS d FROM m), l AS (SELECT *, lag(d) OVER (PARTITION BY y, x ORDER BY frame) AS p FROM dd)", f"SELECT y, x, {r('coalesce(sum(d * p) / sum(d * d), 0)', 'lag1')} FROM l GROUP BY 1, 2"))
def lag1_autocov_image(spark, d):
    return _six(pixel.lag1_image(t.movie(spark, d)), "lag1")


@query(with_(f"{M}, l AS (SELECT *, lag(v) OVER (PARTITION BY y, x ORDER BY frame) AS p FROM m)", f"SELECT y, x, {r('sum(v * p) / count(*)', 'lag1')} FROM l GROUP BY 1, 2"))
def lag1_product_image(spark, d):
    return _six(pixel.lag1_image(t.movie(spark, d), centred=False), "lag1")


@query(with_(M, f"SELECT y, x, {r('stddev_pop(v)', 'std')} FROM m GROUP BY 1, 2"))
def population_std_image(spark, d):
    return t.movie(spark, d).groupBy("y", "x").agg(rounded(F.stddev_pop("v")).alias("std"))


@query(with_(M, f"SELECT frame, {r('avg(v)', 'mean')} FROM m WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 4 GROUP BY 1"))
def rect_roi_trace(spark, d):
    return pixel.frames(t.movie(spark, d), 0, 1 << 62, (2, 6), (1, 5)).groupBy("frame").agg(rounded(F.avg("v")).alias("mean"))


@query(with_(f"{M}, s AS (SELECT frame, v AS seed FROM m WHERE y = 3 AND x = 4)", f"SELECT y, x, {r('corr(v, seed)', 'corr')} FROM m JOIN s USING (frame) GROUP BY 1, 2"))
def seed_corr_map(spark, d):
    m = t.movie(spark, d)
    seed = m.where("y = 3 AND x = 4").select("frame", F.col("v").alias("seed"))
    return m.join(seed, "frame").groupBy("y", "x").agg(rounded(F.corr("v", "seed")).alias("corr"))


@query(with_(f"{M}, tr AS (SELECT y, frame, avg(v) AS v FROM m GROUP BY 1, 2), n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM tr WINDOW w AS (PARTITION BY y ORDER BY frame))", f"SELECT y, frame, {r('v', 'v')} FROM n WHERE v > a AND v > b AND v > 0.02"))
def event_peaks(spark, d):
    w = Window.partitionBy("y").orderBy("frame")
    tr = t.movie(spark, d).groupBy("y", "frame").agg(F.avg("v").alias("v")).withColumns({"a": F.lag("v").over(w), "b": F.lead("v").over(w)})
    return _six(tr.where("v > a AND v > b AND v > 0.02").select("y", "frame", "v"), "v")


@query(with_(f"{M}, l AS (SELECT min(v) AS lo, max(v) AS hi FROM m), h AS (SELECT least(999, CAST(floor((v - lo) / (hi - lo) * 1000) AS INTEGER)) AS bin, count(*) AS n FROM m, l GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM h)", f"SELECT {r('min(lo + (bin + 1) * (hi - lo) / 1000)', 'threshold')} FROM c, l WHERE CAST(cum AS DOUBLE) / total > 0.96"))
def histogram_threshold(spark, d):
    m = t.movie(spark, d)
    lo, hi = m.agg(F.min("v"), F.max("v")).first()
    bins = m.groupBy(F.least(F.lit(999), F.floor((F.col("v") - lo) / (hi - lo) * 1000).cast("int")).alias("bin")).agg(F.count("*").alias("n"))
    c = bins.withColumns({"cum": F.sum("n").over(Window.orderBy("bin")), "total": F.sum("n").over(Window.partitionBy())})
    return c.where(F.col("cum") / F.col("total") > 0.96).agg(rounded(F.min(F.lit(lo) + (F.col("bin") + 1) * (hi - lo) / 1000)).alias("threshold"))


@query(with_(f"{M}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v DESC, y, x) AS n FROM m WHERE y < 7 AND x < 7 AND v > 0)", f"SELECT frame, {r('sum(y * v * v) / sum(v * v)', 'cy')}, {r('sum(x * v * v) / sum(v * v)', 'cx')} FROM k WHERE n <= 15 GROUP BY 1"))
def brightest_centre(spark, d):
    w = Window.partitionBy("frame").orderBy(F.desc("v"), "y", "x")
    k = t.movie(spark, d).where("y < 7 AND x < 7 AND v > 0").withColumn("n", F.row_number().over(w)).where("n <= 15")
    centre = lambda c: rounded(F.sum(F.col(c) * F.col("v") * F.col("v")) / F.sum(F.col("v") * F.col("v"))).alias(f"c{c}")
    return k.groupBy("frame").agg(centre("y"), centre("x"))


_GRID = [(y, x) for y in block_starts(8, 4) for x in block_starts(8, 4)]


@query("SELECT CAST(column0 AS INTEGER) AS y0, CAST(column1 AS INTEGER) AS x0 FROM (VALUES " + ", ".join(f"({y}, {x})" for y in (0, 2, 4) for x in (0, 2, 4)) + ") v(column0, column1)")
def block_grid(spark, d):
    return spark.createDataFrame(_GRID, "y0 int, x0 int")


@query("SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(1 + least(least(y, 4 - y), least(x, 6 - x)) AS DOUBLE) AS weight FROM (SELECT unnest(range(0, 5)) AS y) a, (SELECT unnest(range(0, 7)) AS x) b")
def block_weights(spark, d):
    return spark.createDataFrame([(y, x, float(w)) for y, row in enumerate(pyramid_weights(5, 7)) for x, w in enumerate(row)], "y int, x int, weight double")


@query(with_(f"{M}, tm AS (SELECT y, x, median(v) AS t FROM m WHERE frame < 500 GROUP BY 1, 2)", f"SELECT frame, {r('sum((v - t) * (v - t)) / 64', 'loss')} FROM m JOIN tm USING (y, x) GROUP BY 1"))
def alignment_loss(spark, d):
    m = t.movie(spark, d)
    diff = F.col("v") - F.col("template")
    return m.join(pixel.median_image(m), ["y", "x"]).groupBy("frame").agg(rounded(F.sum(diff * diff) / 64).alias("loss"))


@query(with_(f"{M}, img AS (SELECT y, x, avg(v) AS value FROM m GROUP BY 1, 2)", f"SELECT i.y, i.x, {r('coalesce(sum(j.value), 0)', 'ring')} FROM img i LEFT JOIN img j ON sqrt((i.y - j.y) * (i.y - j.y) + (i.x - j.x) * (i.x - j.x)) BETWEEN 1.5 AND 2.5 GROUP BY 1, 2"))
def ring_kernel_apply(spark, d):
    return _six(pixel.ring_sum(pixel.mean_image(t.movie(spark, d)).withColumnRenamed("mean", "value"), 2), "ring")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) - 1704067200 AS BIGINT) // 3600 AS frame, CAST(user_id // 15 AS INTEGER) AS y, CAST(user_id % 15 AS INTEGER) AS x, round(sum(value), 6) + 0.0 AS v FROM events GROUP BY 1, 2, 3")
def event_frames(spark, d):
    return _six(t.event_movie(spark, d), "v")
