"""A movie as a lazy object: frames of one shape, sliced like an array, worked out when asked for."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Movie:
    """frames (frame, h, w, data), frames 0 to shape[0] - 1."""

    frames: DataFrame
    shape: tuple[int, int, int]

    @staticmethod
    def of(frames: DataFrame) -> Movie:
        """The shape comes from one aggregate over the frame numbers."""
        n, h, w = frames.agg(F.max("frame"), F.first("h"), F.first("w")).first()
        return Movie(frames, (0 if n is None else n + 1, h or 0, w or 0))

    @property
    def ndim(self) -> int:
        return 3

    def _numbers(self, index) -> range | list[int]:
        n = self.shape[0]
        if isinstance(index, (int, np.integer)):
            numbers = [int(index)]
        elif isinstance(index, (list, np.ndarray)):
            numbers = [int(i) for i in np.asarray(index).ravel()]
        else:
            index = slice(index.start, index.stop, index.step) if isinstance(index, range) else index
            for end in (index.start, index.stop):
                if end is not None and abs(end) > n:
                    raise IndexError(f"{end} is beyond {n} frames")
            return range(*index.indices(n))
        if any(i >= n or i < -n for i in numbers):
            raise IndexError(f"beyond {n} frames")
        return [i % n for i in numbers]

    def selected(self, index) -> DataFrame:
        """The frames of an index, as a filter on their numbers."""
        numbers = self._numbers(index)
        if isinstance(numbers, range):
            if not len(numbers):
                return self.frames.where(F.lit(False))
            low, high = min(numbers[0], numbers[-1]), max(numbers[0], numbers[-1])
            step = abs(numbers.step)
            own = F.col("frame").between(low, high)
            return self.frames.where(own if step == 1 else own & ((F.col("frame") - low) % step == 0))
        return self.frames.where(F.col("frame").isin(sorted(set(numbers))))

    def __getitem__(self, index) -> np.ndarray:
        """Frames, and a crop of them, as float32; axes of one element are dropped. It comes to the driver."""
        first, *space = index if isinstance(index, tuple) else (index,)
        if len(space) > 2:
            raise IndexError("a movie has three axes")
        numbers = list(self._numbers(first))
        rows = {r["frame"]: np.asarray(r["data"], np.float32).reshape(self.shape[1:]) for r in self.selected(first).toLocalIterator()}
        out = np.stack([rows[i] for i in numbers]) if numbers else np.empty((0, *self.shape[1:]), np.float32)
        for axis, own in enumerate(space, 1):
            own = [own] if isinstance(own, (int, np.integer)) else (slice(own.start, own.stop, own.step) if isinstance(own, range) else own)
            out = out[(slice(None),) * axis + (own,)]
        return out.squeeze() if out.shape[0] == 1 or any(isinstance(s, (int, np.integer)) for s in space) else out

    def long(self) -> DataFrame:
        """frame, y, x, v."""
        rows = self.frames.select("frame", "w", F.posexplode("data").alias("p", "v"))
        return rows.select("frame", F.expr("CAST(p div w AS INT)").alias("y"), F.expr("CAST(p % w AS INT)").alias("x"), F.col("v").cast("double").alias("v"))


def export(movie: DataFrame, path: str) -> None:
    """Frames with their shifts, as a table; a folder that exists is refused."""
    movie.write.mode("errorifexists").parquet(path)


def reopened(spark, path: str) -> Movie:
    """An exported movie, with its shifts where it has them."""
    return Movie.of(spark.read.parquet(path))


def index_page(folder: str, name: str = "index.html") -> str:
    """An HTML page that links the pages of a folder, in order of the numbers in their names."""
    number = lambda f: ([int(x) for x in "".join(c if c.isdigit() else " " for c in f).split()], f)
    files = sorted((f for f in os.listdir(folder) if f.endswith(".html") and f != name), key=number)
    with open(os.path.join(folder, name), "w") as out:
        out.write("<html><body><ul>\n" + "".join(f'<li><a href="{f}">{f}</a></li>\n' for f in files) + "</ul></body></html>\n")
    return os.path.join(folder, name)
