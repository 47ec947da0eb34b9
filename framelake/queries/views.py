"""Queries of the temporal, spatial and background operators and of the result views, over the embeddings' movie."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import rounded
from framelake.operators import background, factors, graph, pixel, spatial, temporal
from framelake.plans import demix, movies
from framelake.sources import files
from framelake.sources import tables as t

from .factor import _six, _Tables, query
from .sql import ALL, B, M, MAC, MP, UV, A, r, with_

N, SIDE = 64, t.SIDE
_N = "nf AS (SELECT max(frame) AS last FROM m)"
NOISE = "d0 AS (SELECT frame, y, x, v - avg(v) OVER (PARTITION BY y, x) AS d, avg(v) OVER (PARTITION BY y, x) AS mean FROM m), d1 AS (SELECT *, lag(d) OVER (PARTITION BY y, x ORDER BY frame) AS p FROM d0), img AS (SELECT CAST(y * 8 + x AS BIGINT) AS pixel, any_value(mean) AS mean, CASE WHEN avg(d * d) - avg(d * p) < 1e-8 THEN 1 ELSE sqrt(greatest(avg(d * d) - avg(d * p), 0)) END AS std FROM d1 GROUP BY 1)"


def _movie(spark, d):
    return t.movie(spark, d)


@query(with_(M, "SELECT DISTINCT y, x, CASE WHEN y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4 THEN CAST(1 AS DOUBLE) ELSE 0 END AS weight FROM m"))
def border_mask(spark, d):
    return spatial.border_mask(pixel.mean_image(_movie(spark, d)), SIDE, SIDE, 3)


@query(with_(f"{M}, {_N}", f"SELECT frame, y, x, {r('v', 'v')} FROM m, nf WHERE frame >= 10 AND frame <= last - 20"))
def temporal_crop(spark, d):
    return _six(temporal.cropped(_movie(spark, d), 10, 20), "v")


_MEDIAN = "mm AS (SELECT frame, y, x, CASE WHEN row_number() OVER (PARTITION BY y, x ORDER BY frame) > 4 AND row_number() OVER (PARTITION BY y, x ORDER BY frame) <= count(*) OVER (PARTITION BY y, x) - 4 THEN v - median(v) OVER (PARTITION BY y, x ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) ELSE 0 END AS v FROM m)"


@query(with_(f"{M}, {_MEDIAN}", f"SELECT frame, y, x, {r('v', 'v')} FROM mm"))
def moving_median(spark, d):
    return _six(temporal.minus_moving_median(_movie(spark, d), 8), "v")


_DOG = ", ".join(f"({i - 9}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(temporal.difference_of_gaussians()))


@query(with_(f"{M}, w AS (SELECT * FROM (VALUES {_DOG}) q(k, w))", f"SELECT a.frame, a.y, a.x, {r('sum(b.v * w.w)', 'v')} FROM m a, w, m b WHERE b.y = a.y AND b.x = a.x AND b.frame = a.frame + w.k GROUP BY 1, 2, 3"))
def dog_filter(spark, d):
    return _six(temporal.weighted_frames(_movie(spark, d), temporal.difference_of_gaussians()), "v")


_TEMPLATE = "tm AS (SELECT y, x, median(v) AS template FROM m WHERE frame < 500 GROUP BY 1, 2)"


@query(with_(f"{M}, {_TEMPLATE}", f"SELECT frame, {r('sum((1 + x % 2) * (template - v) * (template - v)) / count(*)', 'loss')} FROM m JOIN tm USING (y, x) GROUP BY 1"))
def weighted_alignment_loss(spark, d):
    m = _movie(spark, d)
    weights = pixel.mean_image(m).select("y", "x", (1.0 + F.col("x") % 2).alias("weight"))
    return _six(spatial.alignment_loss(m, pixel.median_image(m), weights), "loss")


_GRAD = "f AS (SELECT y, x, avg(v) AS f FROM m GROUP BY 1, 2), g0 AS (SELECT a.y, a.x, a.f, coalesce((rt.f - lt.f) / 2, 0) AS rx, coalesce((dn.f - up.f) / 2, 0) AS ry FROM f a LEFT JOIN f rt ON rt.y = a.y AND rt.x = a.x + 1 LEFT JOIN f lt ON lt.y = a.y AND lt.x = a.x - 1 LEFT JOIN f dn ON dn.x = a.x AND dn.y = a.y + 1 LEFT JOIN f up ON up.x = a.x AND up.y = a.y - 1), g AS (SELECT y, x, rx - (SELECT sum(f * rx) / sum(f * f) FROM g0) * f AS gx, ry - (SELECT sum(f * ry) / sum(f * f) FROM g0) * f AS gy FROM g0), gg AS (SELECT sum(gx * gx) AS xx, sum(gx * gy) AS xy, sum(gy * gy) AS yy FROM g), pr AS (SELECT frame, sum(v * gx) AS px, sum(v * gy) AS py FROM m JOIN g USING (y, x) GROUP BY 1), sh AS (SELECT frame, (yy * px - xy * py) / (xx * yy - xy * xy) AS sx, (xx * py - xy * px) / (xx * yy - xy * xy) AS sy FROM pr, gg)"


@query(with_(f"{M}, {_GRAD}", f"SELECT y, x, {r('gx', 'gx')}, {r('gy', 'gy')} FROM g"))
def gradient_basis(spark, d):
    return _six(spatial.gradient_basis(pixel.mean_image(_movie(spark, d)), SIDE, SIDE), "gx", "gy")


@query(with_(f"{M}, {_GRAD}", f"SELECT frame, y, x, {r('v - sx * gx - sy * gy', 'v')} FROM m JOIN g USING (y, x) JOIN sh USING (frame)"))
def gradient_corrected(spark, d):
    m = _movie(spark, d)
    basis = graph.checkpointed(spatial.gradient_basis(pixel.mean_image(m), SIDE, SIDE))
    return _six(spatial.gradient_corrected(m, basis), "v")


def _image(spark, d):
    return pixel.noise_image(_movie(spark, d)).select((F.col("y") * SIDE + F.col("x")).cast("long").alias("pixel"), "mean", "std")


@query(with_(f"{ALL}, {UV}, {NOISE}", f"SELECT pixel, frame, {r('value * std + mean', 'value')} FROM uv JOIN img USING (pixel)"))
def pmd_rescaled(spark, d):
    x = _Tables(spark, d)
    return _six(movies.rescaled(factors.product(x.u, x.v), _image(spark, d)), "value")


@query(with_(f"{ALL}, {NOISE}", f"SELECT comp, frame, {r('sum(value * (1 + pixel % 2) * (v - mean) / std)', 'value')} FROM u JOIN mp USING (pixel) JOIN img USING (pixel) GROUP BY 1, 2"))
def regressed_frames(spark, d):
    x = _Tables(spark, d)
    weights = spark.range(N).select(F.col("id").alias("pixel"), (1.0 + F.col("id") % 2).alias("weight"))
    return _six(movies.regressed(x.u, x.m, _image(spark, d), weights), "value")


@query("SELECT CAST(210 AS BIGINT) AS edges")
def grid_edges(spark, d):
    return spark.range(1).select(F.lit(spatial.grid_edges(SIDE, SIDE)).cast("long").alias("edges"))


@query("WITH p AS (SELECT unnest(range(0, 64)) AS id) SELECT a.id AS src, b.id AS dst FROM p a, p b WHERE a.id < b.id AND abs(a.id // 8 - b.id // 8) <= 1 AND abs(a.id % 8 - b.id % 8) <= 1")
def pixel_adjacency(spark, d):
    return spatial.adjacency(pixel.mean_image(_movie(spark, d)), SIDE)


@query(with_(MAC, "SELECT comp, CAST(row_number() OVER (ORDER BY round(peak, 9) DESC, comp) AS INTEGER) AS rank FROM (SELECT comp, max(value) / sqrt(sum(value * value)) AS peak FROM c GROUP BY 1) q"))
def trace_peak_order(spark, d):
    return factors.peak_order(_Tables(spark, d).c)


@query(with_(MAC, "SELECT DISTINCT comp FROM a WHERE pixel // 8 BETWEEN 2 AND 3 AND pixel % 8 BETWEEN 4 AND 5"))
def window_superpixels(spark, d):
    return factors.in_window(t.footprints(spark), SIDE, (2, 4), (4, 6))


@query(with_(MAC, f"SELECT comp, frame, {r('value', 'value')} FROM c WHERE comp IN (1, 4, 7)"))
def pure_columns(spark, d):
    return _six(factors.chosen(_Tables(spark, d).c, spark.createDataFrame([(1,), (4,), (7,)], "comp int")), "value")


_RANK1 = "s AS (SELECT pixel, frame, sum(a.value * c.value) AS x FROM a JOIN c USING (comp) GROUP BY 1, 2), t0 AS (SELECT frame, greatest(avg(value), 0) AS t FROM c GROUP BY 1), l1 AS (SELECT pixel, greatest(sum(x * t) / (SELECT sum(t * t) FROM t0), 0) AS l FROM s JOIN t0 USING (frame) GROUP BY 1)"


@query(with_(f"{MAC}, {_RANK1}", f"SELECT pixel, {r('l', 'value')} FROM l1"))
def rank1_spatial(spark, d):
    x = _Tables(spark, d)
    return _six(factors.rank1_spatial(x.a, x.c, factors.mean_trace(x.c)), "value")


@query(with_(f"{MAC}, {_RANK1}", f"SELECT frame, {r('greatest(sum(x * l) / (SELECT sum(l * l) FROM l1), 0)', 'value')} FROM s JOIN l1 USING (pixel) GROUP BY 1"))
def rank1_temporal(spark, d):
    x = _Tables(spark, d)
    return _six(factors.rank1_temporal(x.a, x.c, factors.rank1_spatial(x.a, x.c, factors.mean_trace(x.c))), "value")


_AFF = "b1 AS (SELECT pixel, CAST(1 AS DOUBLE) AS b FROM p64), m1 AS (SELECT DISTINCT comp, 1 + comp / CAST(10 AS DOUBLE) AS m FROM a), sc AS (SELECT comp, sum(value) AS s, sum(value * value) AS c2 FROM c GROUP BY 1), n2 AS (SELECT comp, sum(value * value) AS norm2 FROM a GROUP BY 1), dt AS (SELECT a.comp, sum(a.value * uv.value * c.value) AS g FROM a JOIN uv USING (pixel) JOIN c ON c.comp = a.comp AND c.frame = uv.frame GROUP BY 1), ab AS (SELECT comp, sum(value * b) AS ab FROM a JOIN b1 USING (pixel) GROUP BY 1), md AS (SELECT p.comp, sum(p.w * q.z * m) AS h FROM (SELECT x.comp, y.comp AS k, sum(x.value * y.value) AS w FROM a x JOIN a y ON x.pixel = y.pixel GROUP BY 1, 2) p JOIN (SELECT x.comp, y.comp AS k, sum(x.value * y.value) AS z FROM c x JOIN c y ON x.frame = y.frame GROUP BY 1, 2) q ON q.comp = p.comp AND q.k = p.k JOIN m1 ON m1.comp = p.k GROUP BY 1)"


@query(with_(f"{ALL}, {UV}, {_AFF}", f"SELECT comp, {r('greatest(m + (g - ab * s - h) / (c2 * norm2), 0)', 'm')} FROM m1 JOIN sc USING (comp) JOIN n2 USING (comp) JOIN dt USING (comp) JOIN ab USING (comp) JOIN md USING (comp)"))
def affine_scale_step(spark, d):
    x = _Tables(spark, d)
    b = spark.range(N).select(F.col("id").alias("pixel"), F.lit(1.0).alias("b"))
    m = x.a.select("comp", (1 + F.col("comp") / 10.0).alias("m")).distinct()
    return _six(background.affine_scale(x.u, x.v, x.a, x.c, b, m), "m")


@query(with_(f"{ALL}, {UV}, {_AFF}", f"SELECT pixel, {r('sum(z)', 'b')} FROM (SELECT pixel, avg(value) AS z FROM uv GROUP BY 1 UNION ALL SELECT pixel, -sum(a.value * m * cm) FROM a JOIN m1 USING (comp) JOIN (SELECT comp, avg(value) AS cm FROM c GROUP BY 1) q USING (comp) GROUP BY 1) t GROUP BY 1"))
def affine_baseline(spark, d):
    x = _Tables(spark, d)
    m = x.a.select("comp", (1 + F.col("comp") / 10.0).alias("m")).distinct()
    return _six(background.affine_baseline(x.u, x.v, x.a, x.c, m), "b")


_BG = "mx AS (SELECT pixel, CAST(k AS INTEGER) AS r, (pixel % (3 + k)) / CAST(4 AS DOUBLE) AS value FROM p64, (SELECT unnest([0, 1]) AS k) q), co AS (SELECT comp AS r, frame, value FROM c WHERE comp < 2), bg AS (SELECT pixel, frame, sum(mx.value * co.value) AS value FROM mx JOIN co USING (r) GROUP BY 1, 2)"


def _background(spark, c):
    ids = spark.range(N).select(F.col("id").alias("pixel"), F.explode(F.array(F.lit(0), F.lit(1))).alias("r"))
    return ids.select("pixel", "r", (F.col("pixel") % (3 + F.col("r")) / 4.0).alias("value")), c.where("comp < 2").withColumnRenamed("comp", "r")


@query(with_(f"{MAC}, {_BG}", f"SELECT pixel, frame, {r('value', 'value')} FROM bg"))
def background_movie(spark, d):
    return _six(background.background_movie(*_background(spark, _Tables(spark, d).c)), "value")


@query(with_(f"{ALL}, {UV}, {_BG}", f"SELECT pixel, {r('sum(z)', 'b')} FROM (SELECT pixel, avg(value) AS z FROM uv GROUP BY 1 UNION ALL SELECT pixel, -avg(value) FROM bg GROUP BY 1 UNION ALL SELECT pixel, -sum(a.value * cm) FROM a JOIN (SELECT comp, avg(value) AS cm FROM c GROUP BY 1) q USING (comp) GROUP BY 1) t GROUP BY 1"))
def background_baseline(spark, d):
    x = _Tables(spark, d)
    return _six(background.baseline(x.u, x.v, x.a, x.c, *_background(spark, x.c)), "b")


@query(with_(f"{MAC}, {_BG}, rg AS (SELECT p.pixel, p.r, coalesce(sum(q.value), 0) AS ring FROM mx p LEFT JOIN mx q ON q.r = p.r AND sqrt((q.pixel // 8 - p.pixel // 8) * (q.pixel // 8 - p.pixel // 8) + (q.pixel % 8 - p.pixel % 8) * (q.pixel % 8 - p.pixel % 8)) BETWEEN CAST(1.5 AS DOUBLE) AND CAST(2.5 AS DOUBLE) GROUP BY 1, 2)", f"SELECT pixel, {r('CASE WHEN sum(ring * ring) = 0 THEN 0 ELSE sum(ring * value) / sum(ring * ring) END', 'weight')} FROM rg JOIN mx USING (pixel, r) GROUP BY 1"))
def ring_weights(spark, d):
    return _six(background.ring_weights(_background(spark, _Tables(spark, d).c)[0], 2, SIDE), "weight")


_ROI = "rp AS (SELECT a.comp, uv.frame, avg(uv.value) AS pmd FROM a JOIN uv USING (pixel) GROUP BY 1, 2), rs AS (SELECT a.comp, ac.frame, avg(ac.value) AS signal FROM a JOIN ac USING (pixel) GROUP BY 1, 2), rb AS (SELECT a.comp, bg.frame, avg(bg.value) AS background FROM a JOIN bg USING (pixel) GROUP BY 1, 2), r0 AS (SELECT a.comp, avg(b) AS base FROM a JOIN b USING (pixel) GROUP BY 1)"
_AC = "ac AS (SELECT pixel, frame, sum(a.value * c.value) AS value FROM a JOIN c USING (comp) GROUP BY 1, 2)"


@query(with_(f"{ALL}, {UV}, {_AC}, {B}, {_BG}, {_ROI}", f"SELECT comp, frame, {r('pmd', 'pmd')}, {r('background', 'background')}, {r('pmd - signal - background - base', 'residual')} FROM rp JOIN rs USING (comp, frame) JOIN rb USING (comp, frame) JOIN r0 USING (comp)"))
def roi_of_three(spark, d):
    x = _Tables(spark, d)
    return _six(demix.roi_of_three(x.u, x.v, x.a, x.c, x.b, *_background(spark, x.c)), "pmd", "background", "residual")


@query(with_(f"{ALL}, {UV}", f"SELECT a.comp, uv.frame, {r('avg(v)', 'raw')}, {r('avg(uv.value)', 'pmd')} FROM a JOIN uv USING (pixel) JOIN mp ON mp.pixel = uv.pixel AND mp.frame = uv.frame GROUP BY 1, 2"))
def roi_raw_and_pmd(spark, d):
    x = _Tables(spark, d)
    raw = factors.roi_averages(x.a, x.raw).withColumnRenamed("mean", "raw")
    return _six(raw.join(factors.roi_averages(x.a, factors.product(x.u, x.v)).withColumnRenamed("mean", "pmd"), ["comp", "frame"]), "raw", "pmd")


@query(with_(f"{ALL}, {UV}, {_AC}, {B}", f"SELECT a.comp, uv.frame, {r('avg(uv.value) / max(avg(uv.value)) OVER (PARTITION BY a.comp)', 'scaled')}, {r('avg(b) / max(avg(uv.value)) OVER (PARTITION BY a.comp)', 'base')} FROM a JOIN uv USING (pixel) JOIN b USING (pixel) GROUP BY 1, 2"))
def roi_panel(spark, d):
    x = _Tables(spark, d)
    return _six(factors.roi_panel(x.a, x.u, x.v, x.b), "scaled", "base")


_RGB = "cl AS (SELECT DISTINCT comp, CAST((comp * 37 + 11) % 100 AS DOUBLE) AS cr, CAST((comp * 53 + 29) % 100 AS DOUBLE) AS cg, CAST((comp * 71 + 47) % 100 AS DOUBLE) AS cb FROM a)"


@query(with_(f"{MAC}, {_RGB}, pj AS (SELECT pixel, sum(a.value * cr) AS red, sum(a.value * cg) AS green, sum(a.value * cb) AS blue FROM a JOIN cl USING (comp) GROUP BY 1)", f"SELECT pixel, {r('red', 'red')}, {r('green', 'green')}, {r('blue', 'blue')} FROM pj"))
def colour_footprints(spark, d):
    return _six(factors.colour_projection(t.footprints(spark), factors.colours(t.footprints(spark))), "red", "green", "blue")


@query(with_(f"{MAC}, {_RGB}, kk AS (SELECT comp, max(value - lo) AS top FROM (SELECT comp, value, min(value) OVER (PARTITION BY comp) AS lo FROM c) q GROUP BY 1), pj AS (SELECT pixel, sum(a.value * top * cr) AS red, sum(a.value * top * cg) AS green, sum(a.value * top * cb) AS blue FROM a JOIN cl USING (comp) JOIN kk USING (comp) GROUP BY 1)", f"SELECT pixel, {r('red / greatest(red, green, blue)', 'red')}, {r('green / greatest(red, green, blue)', 'green')}, {r('blue / greatest(red, green, blue)', 'blue')} FROM pj WHERE greatest(red, green, blue) > 0"))
def colour_max_projection(spark, d):
    x = _Tables(spark, d)
    return _six(factors.colour_maximum(x.a, x.c, factors.colours(x.a)), "red", "green", "blue")


def _ring8(table, value):
    return f"(SELECT p.y, p.x, avg(CASE WHEN p.q < 1e-12 OR n.q < 1e-12 THEN 0 ELSE s / sqrt(p.q * n.q) END) AS {value} FROM (SELECT a.y, a.x, b.y AS oy, b.x AS ox, sum(a.d * b.d) AS s FROM {table} a JOIN {table} b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3, 4) e JOIN q0 p ON p.y = e.y AND p.x = e.x JOIN q0 n ON n.y = e.oy AND n.x = e.ox GROUP BY 1, 2)"


_THREE = "uvl AS (SELECT frame, CAST(pixel // 8 AS INTEGER) AS y, CAST(pixel % 8 AS INTEGER) AS x, value AS v FROM uv), rsl AS (SELECT m.frame, m.y, m.x, m.v - uvl.v AS v FROM m JOIN uvl USING (frame, y, x)), dr AS MATERIALIZED (SELECT frame, y, x, v - avg(v) OVER (PARTITION BY y, x) AS d FROM m), dp AS MATERIALIZED (SELECT frame, y, x, v - avg(v) OVER (PARTITION BY y, x) AS d FROM uvl), de AS MATERIALIZED (SELECT frame, y, x, v - avg(v) OVER (PARTITION BY y, x) AS d FROM rsl), q0 AS MATERIALIZED (SELECT y, x, sum(d * d) AS q FROM dr GROUP BY 1, 2)"


def _three(spark, d):
    x = _Tables(spark, d)
    flat = factors.product(x.u, x.v).select("frame", F.expr("CAST(pixel div 8 AS INT)").alias("y"), F.expr("CAST(pixel % 8 AS INT)").alias("x"), F.col("value").alias("v"))
    return _movie(spark, d), graph.checkpointed(flat)


@query(with_(f"{ALL}, {UV}, {_THREE}", f"SELECT y, x, {r('raw', 'raw')}, {r('pmd', 'pmd')}, {r('residual', 'residual')} FROM {_ring8('dr', 'raw')} a JOIN {_ring8('dp', 'pmd')} b USING (y, x) JOIN {_ring8('de', 'residual')} c USING (y, x)"))
def three_correlation_images(spark, d):
    return _six(pixel.three_correlations(*_three(spark, d)), "raw", "pmd", "residual")


def _lag(table, value):
    return f"(SELECT y, x, coalesce(sum(d * p), 0) / any_value(low) AS {value} FROM (SELECT frame, y, x, d, lag(d) OVER (PARTITION BY y, x ORDER BY frame) AS p FROM {table}) e JOIN (SELECT y, x, CASE WHEN sqrt(q) < 1e-6 THEN 1 ELSE q END AS low FROM q0) n USING (y, x) GROUP BY 1, 2)"


@query(with_(f"{ALL}, {UV}, {_THREE}", f"SELECT y, x, {r('raw', 'raw')}, {r('pmd', 'pmd')}, {r('residual', 'residual')} FROM {_lag('dr', 'raw')} a JOIN {_lag('dp', 'pmd')} b USING (y, x) JOIN {_lag('de', 'residual')} c USING (y, x)"))
def three_lag1_images(spark, d):
    return _six(pixel.three_lag1(*_three(spark, d)), "raw", "pmd", "residual")


_MASK = "RECURSIVE {M}, mk AS (SELECT y, x, CAST(y * 8 + x AS BIGINT) AS id FROM (SELECT y, x, avg(v) AS a FROM m GROUP BY 1, 2) q WHERE (y * 5 + x * 3) % 7 < 3), e AS (SELECT a.id AS s, b.id AS t FROM mk a, mk b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), rc AS (SELECT id, id AS l FROM mk UNION SELECT e.t, rc.l FROM rc JOIN e ON e.s = rc.id), lb AS (SELECT id, min(l) AS label FROM rc GROUP BY 1)".replace("{M}", M)


def _mask(spark, d):
    return pixel.mean_image(_movie(spark, d)).where("(y * 5 + x * 3) % 7 < 3").select("y", "x")


@query(with_(_MASK, f"SELECT label, count(*) AS area, CAST(min(y) AS INTEGER) AS y0, CAST(max(y) AS INTEGER) AS y1, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) AS INTEGER) AS x1, {r('avg(y)', 'cy')}, {r('avg(x)', 'cx')} FROM lb JOIN mk USING (id) GROUP BY 1"))
def connected_regions(spark, d):
    return _six(spatial.region_table(spatial.regions(_mask(spark, d), SIDE)), "cy", "cx")


@query(with_(_MASK, f"SELECT label, frame, {r('avg(v)', 'v')} FROM lb JOIN mk USING (id) JOIN m USING (y, x) GROUP BY 1, 2"))
def region_traces(spark, d):
    return _six(temporal.region_traces(_movie(spark, d), spatial.regions(_mask(spark, d), SIDE)), "v")


_EVENTS = "rt AS (SELECT label, frame, avg(v) AS v FROM lb JOIN mk USING (id) JOIN m USING (y, x) GROUP BY 1, 2), sd AS (SELECT label, stddev_samp(v) AS s FROM rt WHERE frame BETWEEN 9 AND 349 GROUP BY 1), ct AS (SELECT label, frame, CASE WHEN v < 2 * s THEN 0 ELSE v END AS v FROM rt JOIN sd USING (label)), pk AS (SELECT label, frame, v FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS f FROM ct WINDOW w AS (PARTITION BY label ORDER BY frame)) q WHERE v > b AND v > f), ev AS (SELECT label, frame, v FROM (SELECT *, coalesce(frame - lag(frame) OVER w, 4) AS b, coalesce(lead(frame) OVER w - frame, 4) AS f FROM pk WINDOW w AS (PARTITION BY label ORDER BY frame)) q WHERE b > 3 AND f > 3)"


def _events(spark, d):
    return temporal.region_events(temporal.region_traces(_movie(spark, d), spatial.regions(_mask(spark, d), SIDE)), 2.0, 10, 350, 3)


@query(with_(f"{_MASK}, {_EVENTS}", f"SELECT label, frame, {r('v', 'v')} FROM ev"))
def region_events(spark, d):
    return _six(_events(spark, d), "v")


@query(with_(f"{_MASK}, {_EVENTS}", f"SELECT label, ev.frame AS event, m.y, m.x, {r('max(m.v)', 'v')} FROM ev JOIN m ON m.frame BETWEEN ev.frame - 3 AND ev.frame + 3 GROUP BY 1, 2, 3, 4"))
def event_stacks(spark, d):
    return _six(temporal.event_stacks(_movie(spark, d), _events(spark, d), 3), "v")


_POINTS = "RECURSIVE pt AS (SELECT vec_id AS id, floor(CAST(embedding[1] AS DOUBLE) * 400) / CAST(8 AS DOUBLE) AS y, floor(CAST(embedding[2] AS DOUBLE) * 400) / CAST(8 AS DOUBLE) AS x FROM embeddings WHERE vec_id < 300), nr AS (SELECT a.id AS dst, b.id AS src FROM pt a, pt b WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= CAST(0.75 AS DOUBLE) * CAST(0.75 AS DOUBLE)), dn AS (SELECT dst AS id FROM nr GROUP BY 1 HAVING count(*) >= 3), rc AS (SELECT id, id AS l FROM dn UNION SELECT nr.dst, rc.l FROM rc JOIN nr ON nr.src = rc.id JOIN dn ON dn.id = nr.dst), lb AS (SELECT id, min(l) AS label FROM rc GROUP BY 1), bd AS (SELECT nr.dst AS id, min(label) AS border FROM nr JOIN lb ON lb.id = nr.src GROUP BY 1)"


@query(with_(_POINTS, "SELECT id, coalesce(label, border, -1) AS cluster FROM pt LEFT JOIN lb USING (id) LEFT JOIN bd USING (id)"))
def event_clusters(spark, d):
    e = t.read(spark, d, "embeddings").where("vec_id < 300")
    place = lambda i: (F.floor(F.element_at("embedding", i).cast("double") * 400) / 8.0)
    out = spatial.clustered(e.select(F.col("vec_id").alias("id"), place(1).alias("y"), place(2).alias("x")), 0.75, 3)
    return out.select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query(with_(f"{M}, cf AS (SELECT frame // 100 AS cluster, y, x, avg(v) AS value FROM m WHERE frame % 10 = 0 GROUP BY 1, 2, 3), pk AS (SELECT cluster, y AS py, x AS px FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(value, 9) DESC, x, y) AS k FROM cf) q WHERE k = 1)", f"SELECT cluster, y, x, {r('value', 'value')} FROM cf JOIN pk USING (cluster) WHERE abs(y - py) <= 2 AND abs(x - px) <= 2"))
def cluster_footprints(spark, d):
    m = _movie(spark, d)
    return _six(temporal.cluster_footprints(m, m.where("frame % 10 = 0").select(F.expr("frame div 100").alias("cluster"), "frame").distinct(), 2), "value")


@query(with_(f"{_MASK}, tp AS (SELECT y, x, max(v) AS w FROM m GROUP BY 1, 2)", f"SELECT label, {r('sum(y * w * w) / sum(w * w)', 'cy')}, {r('sum(x * w * w) / sum(w * w)', 'cx')} FROM lb JOIN mk USING (id) JOIN tp USING (y, x) GROUP BY 1"))
def region_projection(spark, d):
    return _six(temporal.region_projection(_movie(spark, d), spatial.regions(_mask(spark, d), SIDE)), "cy", "cx")


@query(with_(MP, f"SELECT pixel, frame, {r('v', 'v')} FROM mp WHERE pixel IN (3, 17, 44)"))
def pixel_list_fetch(spark, d):
    return _six(factors.fetched(t.pixels(_movie(spark, d)), [3, 17, 44]), "v")


@query(with_(A, "SELECT p.pixel, k.comp, coalesce(a.value, 0) AS value FROM p64 p CROSS JOIN (SELECT DISTINCT comp FROM a) k LEFT JOIN a ON a.pixel = p.pixel AND a.comp = k.comp"))
def dense_footprints(spark, d):
    return factors.dense(t.footprints(spark), N)


@query(with_(A, "SELECT pixel, comp, value FROM a WHERE value <> 0"))
def sparse_of_dense(spark, d):
    return factors.sparse(factors.dense(t.footprints(spark), N))


@query("SELECT CAST(i AS BIGINT) AS pixel, CAST(i AS INTEGER) AS comp, CAST(1 AS DOUBLE) AS value FROM (SELECT unnest(range(0, 64)) AS i) q")
def sparse_identity(spark, d):
    return factors.identity(spark, N)


@query(with_(f"{MAC}, n AS (SELECT comp, frame, value - avg(value) OVER (PARTITION BY comp) AS d FROM c), z AS (SELECT comp, frame, d / sqrt(sum(d * d) OVER (PARTITION BY comp)) AS v FROM n), l AS (SELECT greatest(max(frame) + 1 - 40, 0) AS last FROM c), st AS (SELECT CAST(unnest(list_distinct(list_append(range(0, last + 1, 20), last))) AS INTEGER) AS start FROM l)", f"SELECT comp, start, CAST(frame - start AS INTEGER) AS i, {r('v', 'value')} FROM z JOIN st ON frame >= start AND frame < start + 40"))
def normalised_snippets(spark, d):
    return _six(temporal.normalised_snippets(_Tables(spark, d).c, 40, 20), "value")


@query(with_(f"{MAC}", f"SELECT comp, {r('quantile_cont(value * value, 0.05)', 'noise')} FROM c GROUP BY 1"))
def noise_quantile(spark, d):
    c = _Tables(spark, d).c
    return _six(factors.noise_quantile(c.select("comp", "frame", (F.col("value") * F.col("value")).alias("total")), 0.05), "noise")


@query(with_(f"{MAC}", f"SELECT pixel, frame, {r('sum(a.value * c.value)', 'value')} FROM a JOIN c USING (comp) WHERE comp % 2 = 0 GROUP BY 1, 2"))
def masked_signals(spark, d):
    x = _Tables(spark, d)
    return _six(factors.product(x.a.where("comp % 2 = 0"), x.c), "value")


_XR = "xr AS MATERIALIZED (SELECT pixel, frame, value - avg(value) OVER (PARTITION BY pixel) AS d FROM (SELECT pixel, frame, uv.value - ac.value AS value FROM uv JOIN ac USING (pixel, frame)) q), kz AS MATERIALIZED (SELECT comp, frame, value - avg(value) OVER (PARTITION BY comp) AS e FROM c), ds AS (SELECT pixel, comp, sum(d * e) AS s, sum(d * d) AS n2, sum(e * e) AS k2 FROM xr JOIN kz USING (frame) GROUP BY 1, 2), rw AS (SELECT ds.pixel, ds.comp, s, n2, k2, a.value AS own FROM ds LEFT JOIN a ON a.pixel = ds.pixel AND a.comp = ds.comp)"
_RESID = "CASE WHEN n2 + 2 * {o} * s + {o} * {o} * k2 < 1e-12 OR k2 < 1e-12 THEN 0 ELSE (s + {o} * k2) / sqrt((n2 + 2 * {o} * s + {o} * {o} * k2) * k2) END"


@query(with_(f"{ALL}, {UV}, {_AC}, {_XR}", f"SELECT pixel, comp, {r(_RESID.format(o='coalesce(own, 0)'), 'corr')} FROM rw"))
def residual_correlation(spark, d):
    x = _Tables(spark, d)
    return _six(background.residual_correlation(x.u, x.v, x.a, x.c, 0), "corr")


@query(with_(f"{ALL}, {UV}, {_AC}, {_XR}", f"SELECT pixel, comp, {r(_RESID.format(o='0'), 'corr')} FROM rw WHERE own IS NULL"))
def residual_correlation_masked(spark, d):
    x = _Tables(spark, d)
    return _six(background.residual_correlation(x.u, x.v, x.a, x.c, 0, mode=background.Mode.MASKED), "corr")


@query(with_(f"{ALL}, {UV}, {_AC}, {_XR}", f"SELECT pixel, comp, {r(_RESID.format(o='0'), 'corr')} FROM rw"))
def residual_correlation_bare(spark, d):
    x = _Tables(spark, d)
    return _six(background.residual_correlation(x.u, x.v, x.a, x.c, 0, mode=background.Mode.RESIDUAL), "corr")


_GROW = "RECURSIVE s AS (SELECT unnest(range(0, 64)) AS id), al AS (SELECT id, id // 8 AS y, id % 8 AS x FROM s WHERE (id * 7) % 5 < 3), gr AS (SELECT id, y, x, 0 AS k FROM al WHERE id IN (0, 37) UNION SELECT al.id, al.y, al.x, gr.k + 1 FROM gr JOIN al ON abs(al.y - gr.y) <= 1 AND abs(al.x - gr.x) <= 1 WHERE gr.k < 3)"


@query(with_(_GROW, "SELECT DISTINCT CAST(1 AS INTEGER) AS comp, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM gr"))
def geodesic_growth(spark, d):
    allowed = spark.range(N).where("(id * 7) % 5 < 3").select(F.lit(1).alias("comp"), F.expr("CAST(id div 8 AS INT)").alias("y"), F.expr("CAST(id % 8 AS INT)").alias("x"))
    seeds = allowed.where("y * 8 + x IN (0, 37)")
    return spatial.grown(seeds, allowed, 3)


@query(with_(f"{A}, s AS (SELECT comp, sum(value) AS s FROM a GROUP BY 1)", f"SELECT pixel, comp, {r('value / s', 'value')} FROM a JOIN s USING (comp)"))
def cell_footprints(spark, d):
    a = t.footprints(spark)
    cells = a.groupBy("comp").agg(F.collect_list(F.struct(F.expr("CAST(pixel div 8 AS INT)").alias("y"), F.expr("CAST(pixel % 8 AS INT)").alias("x"), "value")).alias("z")).select("comp", F.col("z.y").alias("ypix"), F.col("z.x").alias("xpix"), F.col("z.value").alias("lam"))
    return _six(files.footprints_of_cells(cells, SIDE, SIDE)[0], "value")


@query(with_(MAC, f"SELECT c.comp, c.frame, {r('c.value - CAST(0.7 AS DOUBLE) * n.value', 'value')} FROM c JOIN c n ON n.frame = c.frame AND n.comp = (c.comp + 1) % 10"))
def neuropil_subtraction(spark, d):
    c = _Tables(spark, d).c
    near = c.select(((F.col("comp") + 9) % 10).cast("int").alias("comp"), "frame", "value")
    return _six(files.without_neuropil(c, near), "value")

