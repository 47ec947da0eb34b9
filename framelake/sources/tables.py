"""Movies and factor tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8
PIXELS = SIDE * SIDE


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, y, x, v: each embedding as a frame of 8 x 8 pixels."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("p", "e"))
    return rows.select("frame", F.expr(f"p div {SIDE}").cast("int").alias("y"), (F.col("p") % SIDE).cast("int").alias("x"), F.col("e").cast("double").alias("v"))


def pixels(m: DataFrame, width: int = SIDE) -> DataFrame:
    """pixel, frame, v of a movie."""
    return m.select((F.col("y") * width + F.col("x")).cast("long").alias("pixel"), "frame", "v")


def event_movie(spark: SparkSession, sf_dir: str, width: int = 15) -> DataFrame:
    """frame (hour), y, x, v: sums of event values, one pixel a user; absent cells are absent rows."""
    hour = F.floor((F.unix_timestamp("ts") - F.lit(1704067200)) / 3600).cast("long")
    rows = read(spark, sf_dir, "events").groupBy(hour.alias("frame"), "user_id").agg(F.sum("value").alias("v"))
    return rows.select("frame", F.expr(f"user_id div {width}").cast("int").alias("y"), (F.col("user_id") % width).cast("int").alias("x"), "v")


def footprints(spark: SparkSession, n: int = 10, weighted: bool = True) -> DataFrame:
    """pixel, comp, value: two overlapping families of footprints over the 8 x 8 field of view."""
    ids = spark.range(PIXELS).select(F.col("id").alias("pixel"))
    weight = (F.lit(1.0) + F.col("pixel") % 3) if weighted else F.lit(1.0)
    own = ids.select("pixel", (F.col("pixel") % n).cast("int").alias("comp"), weight.alias("value"))
    return own.union(ids.where("pixel % 4 = 0").select("pixel", ((F.col("pixel") + 1) % n).cast("int"), F.lit(0.5)))


def blocks_basis(spark: SparkSession) -> DataFrame:
    """pixel, comp, value: 4 x 4 tiles as a sparse basis."""
    ids = spark.range(PIXELS).select(F.col("id").alias("pixel"))
    return ids.select("pixel", F.expr("(pixel div 8 div 4) * 2 + (pixel % 8) div 4").cast("int").alias("comp"), (F.lit(1.0) + (F.col("pixel") % 5) / 4).alias("value"))


def mean_traces(a: DataFrame, m: DataFrame) -> DataFrame:
    """comp, frame, value: mean of the movie over each footprint's support."""
    return a.select("pixel", "comp").join(m, "pixel").groupBy("comp", "frame").agg(F.avg("v").alias("value"))
