"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The four half-plane neighbours of a pixel: with their opposites, all eight.
HALF = [(0, 1), (1, 0), (1, 1), (1, -1)]
EIGHT = HALF + [(-dy, -dx) for dy, dx in HALF]


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def or_zero(x: Column) -> Column:
    """NULL and NaN as 0."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def at_offsets(df: DataFrame, offsets: list[tuple[int, int]], y: str = "y", x: str = "x") -> DataFrame:
    """A row for each row and offset, moved by it: turns a neighbour join into an equi-join."""
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    return df.withColumn("o", F.explode(moves)).withColumns({y: F.col(y) + F.col("o.dy"), x: F.col(x) + F.col("o.dx"), "dy": F.col("o.dy"), "dx": F.col("o.dx")}).drop("o")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
