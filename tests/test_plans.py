"""Strategies, compression, demixing and pipelines on planted movies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.kernels import denoise, images
from framelake.operators import background, factors, pixel
from framelake.plans import demix, movies, pipelines, strategies
from framelake.sources.files import array_movie
from framelake.sources.movie import Movie


def blob(h, w, y, x, s=1.5):
    yy, xx = np.mgrid[:h, :w]
    return np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * s * s)) * ((yy - y) ** 2 + (xx - x) ** 2 <= 9)


def image_of(rows, h, w):
    out = {}
    for r in rows:
        out.setdefault(r["comp"], np.zeros(h * w))[r["pixel"]] = r["value"]
    return out


def traces_of(rows, n):
    out = {}
    for r in rows:
        out.setdefault(r["comp"], np.zeros(n))[r["frame"]] = r["value"]
    return out


def test_rigid_strategy_keeps_the_shape(spark):
    """As many frames of the same size come out, also for four random ones, with a template made of them."""
    x = np.random.default_rng(0).integers(0, 4096, (4, 32, 32)).astype(np.int16)
    movie = Movie.of(array_movie(spark, x))
    strategy = strategies.Rigid(max_shifts=(3, 3)).fitted(movie.frames, passes=2)
    out = Movie.of(strategy.correct(movie.frames))
    assert out.shape == movie.shape and out[:].shape == x.shape and strategy.template.shape == (32, 32)
    with pytest.raises(ValueError):
        strategies.Rigid().correct(movie.frames)


def test_strategies_undo_shifts_of_a_second_movie_too(spark):
    rng = np.random.default_rng(3)
    f = sum(rng.normal() * blob(40, 40, *rng.uniform(5, 35, 2), 2.5) for _ in range(40))
    shifts = [(0, 0), (1, -2), (-2, 1), (2, 2), (0, 1)]
    moved = np.array([images.shift_frame(f, *s) for s in shifts])
    movie, other = (array_movie(spark, m) for m in (moved, 3 * moved))
    strategy = strategies.Rigid(template=f, max_shifts=(4, 4))
    got = sorted(strategy.correct(movie, other).collect(), key=lambda r: r["frame"])
    assert all(abs(r["dy"] + s[0]) < 0.02 and abs(r["dx"] + s[1]) < 0.02 for r, s in zip(got, shifts, strict=True))
    assert all(np.abs(np.reshape(r["data"], (40, 40))[4:-4, 4:-4] - 3 * f[4:-4, 4:-4]).max() < 0.05 for r in got)
    piecewise = strategies.Piecewise(f, (2, 2), (6, 6), (4, 4), (1, 1))
    for r in piecewise.correct(movie).collect():
        assert len(r["field"]) == 8 and np.abs(np.reshape(r["data"], (40, 40))[5:-5, 5:-5] - f[5:-5, 5:-5]).max() < 0.1
    same = strategies.Identity().correct(movie).where("frame = 1").first()
    assert (same["dy"], same["dx"]) == (0, 0) and np.allclose(np.reshape(same["data"], (40, 40)), moved[1], atol=1e-5)
    assert strategies.chunks(450, 200) == [(0, 200), (200, 400), (250, 450)] and strategies.chunks(50, 200) == [(0, 50)]


def planted(n=120, h=24, w=24, seed=0):
    rng = np.random.default_rng(seed)
    shapes = [blob(h, w, 7, 7), blob(h, w, 7, 11), blob(h, w, 17, 15)]
    courses = [np.convolve(rng.random(n) < 0.08, np.exp(-np.arange(12) / 4))[:n] * 3 + 0.01 for _ in shapes]
    movie = np.einsum("kyx,kt->tyx", np.array(shapes), np.array(courses)) + 5 + rng.normal(0, 0.03, (n, h, w))
    return movie, shapes, courses


def factored(spark, movie):
    """An exact factorisation in 6 x 6 tiles: enough components for everything in the movie but noise."""
    n, h, w = movie.shape
    rows_u, rows_v, k = [], [], 0
    for y in range(0, h, 6):
        for x in range(0, w, 6):
            own = movie[:, y : y + 6, x : x + 6].reshape(n, -1).T
            own = own - own.mean(axis=1, keepdims=True)
            u, s, v = np.linalg.svd(own, full_matrices=False)
            for i in range(4):
                rows_u += [((y + p // 6) * w + x + p % 6, k, float(u[p, i])) for p in range(36)]
                rows_v += [(k, t, float(s[i] * v[i, t])) for t in range(n)]
                k += 1
    return spark.createDataFrame(rows_u, "pixel long, comp int, value double"), spark.createDataFrame(rows_v, "comp int, frame long, value double")


def test_demixing_finds_planted_signals_and_merges_a_split_one(spark, tmp_path):
    movie, shapes, courses = planted()
    n, h, w = movie.shape
    u, v = factored(spark, movie)
    # seeds: each cell's middle, and the third one twice, in two overlapping halves
    starts = [blob(h, w, 7, 7) > 0.2, blob(h, w, 7, 11) > 0.2, (blob(h, w, 17, 15) > 0.05) & (np.arange(w) <= 16), (blob(h, w, 17, 15) > 0.05) & (np.arange(w) >= 14)]
    a = spark.createDataFrame([(int(p), k, 1.0) for k, m in enumerate(starts) for p in np.flatnonzero(m.ravel())], "pixel long, comp int, value double")
    a, c = demix.custom_seeds(u, v, a, rounds=5)
    out = demix.demix(u, v, a, c, demix.DemixConfig(rounds=4, update_every=2, deletion_threshold=0.1, support_threshold=(0.7, 0.8), merge_threshold=0.7), (h, w))
    found, traces = image_of(out.a.collect(), h, w), traces_of(out.c.collect(), n)
    assert len(found) == 3
    for s, t in zip(shapes, courses, strict=True):
        best = max(found, key=lambda k: np.corrcoef(traces[k], t)[0, 1])
        assert np.corrcoef(traces[best], t)[0, 1] > 0.97 and np.corrcoef(found[best], s.ravel())[0, 1] > 0.9
    left = out.residual().agg(F.avg("value"), F.stddev("value")).first()
    assert abs(left[0]) < 1e-9 and left[1] < 0.1
    out.save(str(tmp_path / "r"))
    again = demix.DemixResults.load(spark, str(tmp_path / "r"))
    assert again.mix is None and again.a.count() == out.a.count()
    with pytest.raises(Exception, match="already exists"):
        out.save(str(tmp_path / "r"))
    roi = out.roi_averages().where("frame = 3").collect()
    assert len(roi) == 3 and all(r["background"] == 0 for r in roi)


def test_background_takes_a_common_course(spark):
    movie, shapes, courses = planted(seed=2)
    n, h, w = movie.shape
    common = np.sin(np.arange(n) / 9)
    u, v = factored(spark, movie + common[:, None, None] * 2)
    a = spark.createDataFrame([(int(p), k, float(s.ravel()[p])) for k, s in enumerate(shapes) for p in np.flatnonzero(s.ravel() > 0)], "pixel long, comp int, value double")
    c = spark.createDataFrame([(k, t, float(x)) for k, course in enumerate(courses) for t, x in enumerate(course - course.min())], "comp int, frame long, value double")
    config = demix.DemixConfig(background_bins=4, background_rank=5, ring_radius=3)
    bg, rank = demix.low_rank_background(u, v, a, c, factors.baseline(u, v, a, c), h, w, config)
    course = bg.course.where("r = 0").orderBy("frame").toPandas()["value"].to_numpy()
    assert rank <= 3 and abs(np.corrcoef(course, common)[0, 1]) > 0.98
    ring = demix.ring_background(u, bg, config, w)
    movie_of = background.background_movie(ring.mix, ring.course).where("pixel = 300").orderBy("frame").toPandas()["value"].to_numpy()
    assert np.corrcoef(movie_of, common)[0, 1] > 0.95
    b = background.baseline(u, v, a, c, bg.mix, bg.course)
    assert b.count() == h * w


def test_affine_fit_and_factored_svd(spark):
    movie, shapes, courses = planted(seed=4)
    n, h, w = movie.shape
    u, v = factored(spark, movie)
    a = spark.createDataFrame([(int(p), k, float(s.ravel()[p])) for k, s in enumerate(shapes) for p in np.flatnonzero(s.ravel() > 0)], "pixel long, comp int, value double")
    c = spark.createDataFrame([(k, t, float(x) / (k + 2)) for k, course in enumerate(courses) for t, x in enumerate(course)], "comp int, frame long, value double")
    scaled, b = demix.affine_fit(u, v, a, c, 25)
    first = {r["comp"]: r["value"] for r in c.where("frame = 60").collect()}
    ratio = {r["comp"]: r["value"] / first[r["comp"]] for r in scaled.where("frame = 60").collect()}
    assert all(abs(ratio[k] - (k + 2)) < 0.1 * (k + 2) for k in range(3)) and b.count() == h * w
    mix, s, right, names = background.factored_svd(u, v)
    dense_u, dense_v = np.zeros((h * w, len(names))), np.zeros((len(names), n))
    for r in u.collect():
        dense_u[r["pixel"], names.index(r["comp"])] = r["value"]
    for r in v.collect():
        dense_v[names.index(r["comp"]), r["frame"]] = r["value"]
    left = dense_u @ mix
    assert np.allclose(left.T @ left, np.eye(len(s)), atol=1e-6) and np.allclose(left * s @ (right @ dense_v), dense_u @ dense_v, atol=1e-6)
    assert np.allclose(s[:5], np.linalg.svd(dense_u @ dense_v)[1][:5])


def test_whole_compression_with_calibration_and_a_sample_of_frames(spark):
    movie, *_ = planted(n=160, h=16, w=16, seed=6)
    long = Movie.of(array_movie(spark, movie)).long()
    how = strategies.Compress(block=(8, 8), rank=3, failures=1, runs=12)
    made = how.compress(long, 16, 16, 160)
    got = np.zeros((256, 160))
    for r in made.movie().collect():
        got[r["pixel"], r["frame"]] = r["value"]
    want = movie.reshape(160, -1).T
    assert np.corrcoef(got.ravel(), want.ravel())[0, 1] > 0.9
    part = strategies.Compress(block=(8, 8), rank=3, runs=12, fit_frames=80).compress(long, 16, 16, 160)
    assert part.v.agg(F.countDistinct("frame")).first()[0] == 160
    net = strategies.CompressDenoise(how, denoise.new_network(0), quantile=0.05).compress(long, 16, 16, 160)
    assert net.v.count() > 0
    with pytest.raises(ValueError):
        strategies.CompressDenoise().compress(long, 16, 16, 160)


def test_pipeline_from_frames_to_signals(spark):
    movie, shapes, courses = planted(n=100, h=20, w=20, seed=7)
    config = pipelines.PipelineConfig(
        registration=strategies.Identity(), compression=strategies.Compress(block=(10, 10), rank=4, failures=2, runs=10),
        passes=((pipelines.SeedConfig(cutoff=0.6, distance=2), demix.DemixConfig(rounds=2, update_every=2, deletion_threshold=0.05)),),
    )
    out = pipelines.run(Movie.of(array_movie(spark, movie)), config)
    traces = traces_of(out.demixed.c.collect(), 100)
    assert traces and max(np.corrcoef(t, courses[2])[0, 1] for t in traces.values()) > 0.9
    wide = pipelines.run_widefield(Movie.of(array_movie(spark, movie[:40])), pipelines.PipelineConfig(registration=strategies.Identity(), compression=config.compression, highpass_sigma=1.5))
    assert wide.demixed is None and wide.compressed.v.count() > 0


def test_noise_term_and_given_norms(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 4, 4))
    m = Movie.of(array_movie(spark, x)).long()
    plain, damped = ({(r["y"], r["x"]): r["corr"] for r in pixel.neighbour_correlation(m, noise=s).collect()} for s in (0.0, 1.0))
    d = x - x.mean(axis=0)
    n2 = (d**2).sum(axis=0)
    pair = [(a, b) for a, b in ((0, 1), (1, 0), (1, 1))]
    for got, extra in ((plain, 0.0), (damped, 30.0)):
        want = np.mean([(d[:, 0, 0] * d[:, a, b]).sum() / np.sqrt((n2[0, 0] + extra) * (n2[a, b] + extra)) for a, b in pair])
        assert abs(got[0, 0] - want) < 1e-6


def test_streamed_frames_are_registered_once(spark, tmp_path):
    from framelake import streaming

    f = blob(16, 16, 8, 8, 3)
    frames = array_movie(spark, np.array([images.shift_frame(f, s, 0) for s in (0, 1, -1)])).select("frame", "h", "w", F.col("data").cast("array<double>").alias("data"))
    frames.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.registered(streaming.frames_of_folder(spark, str(tmp_path / "in"), 1), strategies.Rigid(f, (2, 2)))
    for _ in range(2):  # a restart adds nothing
        streaming.kept(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {r["frame"]: r["dy"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 3 and all(abs(got[i] + s) < 0.02 for i, s in enumerate((0, 1, -1)))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_high_passed_movie_and_traces(spark):
    movie, *_ = planted(n=30, h=12, w=12, seed=9)
    u, v = factored(spark, movie)
    image = spark.range(144).select(F.col("id").alias("pixel"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"))
    _, new, after = movies.spatially_filtered(u, v, image, 12, 12, 1.0)
    assert new.count() == v.count() and after.where("std = 1").count() == 144
