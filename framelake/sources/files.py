"""Movies in files: raw binary, TIFF and NumPy readers, as frames (frame, h, w, data), one array a row.

Only names and lengths of files are listed first; tasks then open their own part of a file (a run of frames, or of
pages), so a file of any size is read in parallel and no frame is ever split into pixels. Paths may be in any store that
pyarrow opens (local, hdfs, s3, gcs); all executors must reach them.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "frame long, h int, w int, data array<float>"
#: Bytes of one task's run of frames.
PART_BYTES = 64 << 20


def _open(path: str):
    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


def _batch(numbers: list[int], frames: list[np.ndarray]) -> pa.RecordBatch:
    n = len(numbers)
    h, w = frames[0].shape
    flat = np.ascontiguousarray(np.stack(frames), np.float32).ravel()
    data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h * w, pa.int32()), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()), data], ["frame", "h", "w", "data"])


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files, without their content."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def _first_frames(counts: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """path, frames and number of its first frame, the files in order of their names."""
    out, at = [], 0
    for path, n in sorted(counts):
        out.append((path, n, at))
        at += n
    return out


def raw_movie(spark: SparkSession, path: str, height: int, width: int, kind: str = "<i2", frames: int | None = None, flipped: bool = False) -> DataFrame:
    """A flat binary movie, or several in order of their names; a frame cut short at a file's end is dropped.

    kind: a NumPy type with byte order, such as <i2 or <u2. frames: how many the header promises; fewer is an error.
    flipped: negative polarity, as some indicators darken.
    """
    size = height * width * np.dtype(kind).itemsize
    files = _first_frames([(r["path"], r["length"] // size) for r in _listed(spark, path).collect()])
    there = sum(n for _, n, _ in files)
    if frames is not None and there < frames:
        raise ValueError(f"{there} whole frames where {frames} are promised")
    step = max(1, PART_BYTES // size)
    parts = [(p, a, min(step, n - a), first + a) for p, n, first in files for a in range(0, n, step)]

    def read(batches):
        for batch in batches:
            for p, a, n, first in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "n", "first")), strict=True):
                with _open(p) as file:
                    file.seek(a * size)
                    for k in range(0, n, 64):
                        some = np.frombuffer(file.read(size * min(64, n - k)), kind).reshape(-1, height, width).astype(np.float32)
                        yield _batch(list(range(first + k, first + k + len(some))), list(-some if flipped else some))

    out = spark.createDataFrame(parts, "path string, at long, n long, first long").repartition(max(1, len(parts)), "first").mapInArrow(read, FRAMES)
    return out if frames is None else out.where(F.col("frame") < frames)


_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
#: TIFF tags (fixed values).
WIDTH, LENGTH, BITS, COMPRESSION, OFFSETS, SAMPLES, COUNTS, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 279, 339


def tiff_pages(file) -> list[dict]:
    """Of each page: its height, width, type, and the offsets and lengths of its strips. Plain and big TIFF, uncompressed."""
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    cell, count = ("Q", "Q") if big else ("I", "H")
    step, entry = struct.calcsize(cell), 20 if big else 12
    pages = []
    while at:
        file.seek(at)
        n = struct.unpack(order + count, file.read(struct.calcsize(count)))[0]
        raw = file.read(n * entry + step)
        tags = {}
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, k * entry)
            many = struct.unpack_from(order + cell, raw, k * entry + 4)[0]
            value = raw[k * entry + 4 + step : k * entry + 4 + 2 * step]
            if kind not in _CODE:
                continue
            if many * _SIZE[kind] > step:
                file.seek(struct.unpack(order + cell, value)[0])
                value = file.read(many * _SIZE[kind])
            tags[tag] = struct.unpack(order + str(many) + _CODE[kind], value[: many * _SIZE[kind]])
        if tags.get(COMPRESSION, (1,))[0] != 1:
            raise ValueError("only uncompressed TIFF pages can be read")
        if tags.get(SAMPLES, (1,))[0] != 1:
            raise ValueError("only pages of one sample a pixel can be read")
        letter = {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE_FORMAT, (1,))[0]]
        pages.append({"h": tags[LENGTH][0], "w": tags[WIDTH][0], "kind": f"{order}{letter}{tags.get(BITS, (1,))[0] // 8}", "offsets": list(tags[OFFSETS]), "lengths": list(tags[COUNTS])})
        at = struct.unpack(order + cell, raw[n * entry :])[0]
    return pages


def tiff_movie(spark: SparkSession, path: str) -> DataFrame:
    """The pages of TIFF files as frames, files in order of their names; the pages of one file may be read by many tasks."""

    def scan(batches):
        for batch in batches:
            for p in batch.column("path").to_pylist():
                with _open(p) as file:
                    for i, page in enumerate(tiff_pages(file)):
                        yield pa.RecordBatch.from_pylist([{"path": p, "page": i, **page}], schema=layout)

    layout = pa.schema([("path", pa.string()), ("page", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("kind", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
    pages = _listed(spark, path).select("path").mapInArrow(scan, "path string, page long, h int, w int, kind string, offsets array<long>, lengths array<long>")
    files = _first_frames([(r["path"], r["n"]) for r in pages.groupBy("path").agg(F.count("*").alias("n")).collect()])
    first = spark.createDataFrame([(p, at) for p, _, at in files], "path string, first long")

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as file:
                    raw = io.BytesIO()
                    for at, n in zip(r["offsets"], r["lengths"], strict=True):
                        file.seek(at)
                        raw.write(file.read(n))
                yield _batch([r["first"] + r["page"]], [np.frombuffer(raw.getvalue(), r["kind"]).reshape(r["h"], r["w"]).astype(np.float32)])

    placed = pages.join(first, "path").repartition(F.expr("(first + page) div 64"))
    return placed.mapInArrow(read, FRAMES)


def write_tiff(path: str, movie: np.ndarray) -> None:
    """A movie (frames, h, w) as an uncompressed multipage TIFF, one strip a page."""
    kind = movie.dtype.newbyteorder("<")
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    with open(path, "wb") as file:
        file.write(struct.pack("<2sHI", b"II", 42, 8))
        for i, frame in enumerate(movie):
            data, at = frame.astype(kind).tobytes(), file.tell()
            tags = [(WIDTH, 4, frame.shape[1]), (LENGTH, 4, frame.shape[0]), (BITS, 3, 8 * kind.itemsize), (COMPRESSION, 3, 1), (OFFSETS, 4, at + 6 + 12 * 8), (SAMPLES, 3, 1), (COUNTS, 4, len(data)), (SAMPLE_FORMAT, 3, form)]
            file.write(struct.pack("<H", len(tags)))
            for tag, code, value in tags:
                file.write(struct.pack("<HHI", tag, code, 1) + (struct.pack("<HH", value, 0) if code == 3 else struct.pack("<I", value)))
            file.write(struct.pack("<I", at + 6 + 12 * 8 + len(data) if i + 1 < len(movie) else 0))
            file.write(data)


def hdf5_movie(spark: SparkSession, path: str, field: str, frames_a_task: int = 256) -> DataFrame:
    """A dataset (frames, h, w) of one HDF5 file; needs h5py on every machine."""
    import h5py

    with h5py.File(path, "r") as file:
        n = file[field].shape[0]

    def read(batches):
        for batch in batches:
            for a in batch.column("id").to_pylist():
                with h5py.File(path, "r") as file:
                    some = file[field][a : a + frames_a_task].astype(np.float32)
                yield _batch(list(range(a, a + len(some))), list(some))

    return spark.range(0, n, frames_a_task, numPartitions=max(1, n // frames_a_task)).mapInArrow(read, FRAMES)


def array_movie(spark: SparkSession, movie: np.ndarray) -> DataFrame:
    """A movie that the driver holds."""
    table = pa.Table.from_batches([_batch(list(range(a, min(len(movie), a + 64))), list(movie[a : a + 64])) for a in range(0, len(movie), 64)])
    return spark.createDataFrame(table).select("frame", F.col("h").cast("int"), F.col("w").cast("int"), "data")


def footprints_of_cells(cells: DataFrame, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Weights scaled to sum 1 and uniform masks (pixel, comp, value) of cells (comp, ypix, xpix, lam: arrays).

    Pixels outside the field of view are left out.
    """
    rows = cells.select("comp", F.explode(F.arrays_zip("ypix", "xpix", "lam")).alias("z")).select("comp", F.col("z.ypix").alias("y"), F.col("z.xpix").alias("x"), F.col("z.lam").alias("lam"))
    rows = rows.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select((F.col("y") * width + F.col("x")).cast("long").alias("pixel"), "comp", "lam")
    total = rows.groupBy("comp").agg(F.sum("lam").alias("total"))
    return rows.join(total, "comp").select("pixel", "comp", (F.col("lam") / F.col("total")).alias("value")), rows.select("pixel", "comp", F.lit(1.0).alias("value"))


def without_neuropil(traces: DataFrame, neuropil: DataFrame, share: float = 0.7) -> DataFrame:
    """comp, frame, value: traces less a share of the neuropil's."""
    return traces.join(neuropil.withColumnRenamed("value", "n"), ["comp", "frame"]).select("comp", "frame", (F.col("value") - share * F.col("n")).alias("value"))


def cells_of_stat(spark: SparkSession, path: str) -> DataFrame:
    """comp, ypix, xpix, lam of a pickled list of cell records (stat.npy); read only files that you trust."""
    stat = np.load(path, allow_pickle=True)
    return spark.createDataFrame([(i, [int(v) for v in s["ypix"]], [int(v) for v in s["xpix"]], [float(v) for v in s["lam"]]) for i, s in enumerate(stat)], "comp int, ypix array<int>, xpix array<int>, lam array<double>")
