"""Readers and the lazy movie, on files that the tests write."""

import struct

import numpy as np
import pytest

from framelake.sources import files
from framelake.sources.movie import Movie, export, index_page, reopened


def held(df):
    rows = sorted(df.collect(), key=lambda r: r["frame"])
    assert [r["frame"] for r in rows] == list(range(len(rows)))
    return np.array([np.reshape(r["data"], (r["h"], r["w"])) for r in rows])


@pytest.mark.parametrize("kind", ["<i2", "<u2", ">i2"])
def test_raw_files_in_order_with_a_cut_frame(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(files, "PART_BYTES", 3 * 6 * 5 * 2)
    movie = np.random.default_rng(0).integers(0, 3000, (11, 6, 5)).astype(kind)
    (tmp_path / "a.bin").write_bytes(movie[:7].tobytes() + b"\1\2\3")
    (tmp_path / "b.bin").write_bytes(movie[7:].tobytes())
    assert (held(files.raw_movie(spark, str(tmp_path / "*.bin"), 6, 5, kind)) == movie).all()
    assert (held(files.raw_movie(spark, str(tmp_path / "*.bin"), 6, 5, kind, frames=9, flipped=True)) == -movie[:9].astype(float)).all()
    with pytest.raises(ValueError):
        files.raw_movie(spark, str(tmp_path / "*.bin"), 6, 5, kind, frames=12)


@pytest.mark.parametrize("kind", ["u1", "<u2", "<i2", "<f4"])
def test_tiff_pages(spark, tmp_path, kind):
    movie = np.random.default_rng(1).integers(0, 200, (9, 7, 4)).astype(kind)
    files.write_tiff(str(tmp_path / "b.tif"), movie[5:])
    files.write_tiff(str(tmp_path / "a.tif"), movie[:5])
    assert (held(files.tiff_movie(spark, str(tmp_path / "*.tif"))) == movie).all()


def test_tiff_of_the_other_byte_order_and_two_strips(spark, tmp_path):
    frame = np.arange(24).reshape(4, 6).astype(">u2")
    strips = [frame[:2].tobytes(), frame[2:].tobytes()]
    tags = [(256, 3, 1, struct.pack(">HH", 6, 0)), (257, 3, 1, struct.pack(">HH", 4, 0)), (258, 3, 1, struct.pack(">HH", 16, 0)), (273, 4, 2, struct.pack(">I", 100)), (279, 4, 2, struct.pack(">I", 108))]
    head = struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", a, b, c) + d for a, b, c, d in tags) + struct.pack(">I", 0)
    body = head.ljust(100, b"\0") + struct.pack(">II", 200, 200 + len(strips[0])) + struct.pack(">II", *map(len, strips))
    (tmp_path / "x.tif").write_bytes(body.ljust(200, b"\0") + b"".join(strips))
    assert (held(files.tiff_movie(spark, str(tmp_path / "x.tif")))[0] == frame).all()
    (tmp_path / "y.tif").write_bytes(b"no tiff at all..")
    with pytest.raises(Exception, match="not a TIFF"):
        files.tiff_movie(spark, str(tmp_path / "y.tif")).count()


def test_lazy_movie(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(10, 5, 6)).astype(np.float32)
    movie = Movie.of(files.array_movie(spark, x))
    assert movie.shape == (10, 5, 6) and movie.ndim == 3
    for index in (3, -1, slice(2, 7), slice(None), slice(1, 9, 3), range(4, 8), [5, 2, 2], np.array([0, 9]), (slice(0, 4), 2), (slice(3, 6), slice(1, 3), slice(2, 5)), (4, slice(0, 2), 1)):
        own = index if not isinstance(index, range) else slice(index.start, index.stop)
        assert np.array_equal(movie[index], x[own].squeeze() if not isinstance(own, (list, np.ndarray)) else x[own]), index
    assert movie[slice(4, 5)].shape == (5, 6) and movie[slice(4, 4)].shape == (0, 5, 6)
    for bad in (10, -11, [3, 12], slice(0, 11), range(5, 12), (0, 0, 0, 0)):
        with pytest.raises(IndexError):
            movie[bad]
    assert movie.long().where("frame = 4 AND y = 3 AND x = 2").first()["v"] == pytest.approx(float(x[4, 3, 2]))
    export(movie.frames, str(tmp_path / "m"))
    assert np.array_equal(reopened(spark, str(tmp_path / "m"))[:], x)
    with pytest.raises(Exception, match="already exists"):
        export(movie.frames, str(tmp_path / "m"))


def test_cells_and_index_page(spark, tmp_path):
    stat = np.array([{"ypix": np.array([0, 1, 9]), "xpix": np.array([1, 1, 1]), "lam": np.array([1.0, 3.0, 5.0])}, {"ypix": np.array([2]), "xpix": np.array([2]), "lam": np.array([2.0])}], dtype=object)
    np.save(tmp_path / "stat.npy", stat, allow_pickle=True)
    weights, masks = files.footprints_of_cells(files.cells_of_stat(spark, str(tmp_path / "stat.npy")), 4, 4)
    assert sorted(map(tuple, weights.collect())) == [(1, 0, 0.25), (5, 0, 0.75), (10, 1, 1.0)] and masks.count() == 3
    for n in ("cell_10.html", "cell_2.html"):
        (tmp_path / n).write_text("x")
    page = open(index_page(str(tmp_path))).read()
    assert page.index("cell_2.html") < page.index("cell_10.html")
