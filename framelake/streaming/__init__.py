"""Movies that are still being recorded: frames registered as they arrive, and events binned into frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans import movies


def frames_of_folder(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    """A stream of the frames (frame, h, w, data) that are written to a folder as Parquet files."""
    return spark.readStream.schema(movies.FRAME).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def registered(frames: DataFrame, strategy) -> DataFrame:
    """A stream of frames corrected one by one by a strategy with a template; no state is kept."""
    return strategy.correct(frames)


def event_frames(events: DataFrame, every: str = "1 hour", late: str = "1 hour", width: int = 15) -> DataFrame:
    """start, y, x, v: sums of event values (ts, user_id, value) by window and pixel, once a window can get no more.

    Events later than `late` behind the latest seen are left out, as a watermark must.
    """
    binned = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "user_id").agg(F.sum("value").alias("v"))
    return binned.select(F.col("w.start").alias("start"), F.expr(f"CAST(user_id div {width} AS INT)").alias("y"), (F.col("user_id") % width).cast("int").alias("x"), "v")


def kept(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """The stream appended to a folder; a restart goes on from the checkpoint, and no frame is written twice."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
