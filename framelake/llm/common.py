"""Helpers that the text operators share: table access, shared scratch tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (Java and Python agree on this class).
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of one Arrow batch sent to a Python worker, so that very long texts cannot pile up.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory, read by Spark only (the directory may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes as well as by rows.

    Spark reads these settings when a plan runs, so they stay in the session; a limit that is lower already is kept.
    """
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Only where one machine is all there is may it be unset."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of a column, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def word_count(text):
    """Number of words in a text column, null as 0, by built-in functions."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(gaps, WORD_GAP, "")).cast("long")


def keyed(seed: str, *cols):
    """A 60-bit number from an MD5 of the columns: the same in every engine and on every run."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")
