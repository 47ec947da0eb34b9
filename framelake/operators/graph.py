"""Graphs of pixels and components as edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again; where one machine is all there is, that may be unset.

    A table is written in one pass, where checkpoint() would work it out twice. It goes when the driver ends.
    """
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", place)
    path = f"{place.rstrip('/')}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: each node of nodes (id) and the smallest id that edges (src, dst) let it reach.

    Rounds of a grouped minimum over neighbours and a jump to the label's own label, each in the checkpoint folder.
    """
    both = checkpointed(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    now = checkpointed(nodes.select(F.col("id").alias("id"), F.col("id").alias("label")))
    while True:
        near = both.join(now, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = now.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = checkpointed(step.join(jump, "label").select("id", F.col("further").alias("label")))
        if new.join(now.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty():
            return new
        now = new


def greedy_colours(edges: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    """Colours so that linked components differ, most linked first; one node a component, on the driver."""
    near: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    colour: dict[int, int] = {}
    for n in sorted(nodes, key=lambda n: (-len(near[n]), n)):
        used = {colour[m] for m in near[n] if m in colour}
        colour[n] = next(c for c in range(len(nodes) + 1) if c not in used)
    return colour
