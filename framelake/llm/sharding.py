"""Shards by a permutation-filled lookup table: built once, broadcast, one probe a document.

Each shard has its own order of preference over the slots of a table of prime size. Shards take turns, each
claiming its most preferred free slot, until all slots are taken; so shares differ by at most one slot, and
adding or removing a shard moves few slots. A document's slot is its keyed hash modulo the table size.

Rows with a null id hash like any other value and share one slot; repeated rows go to the same shard; empty
tables give no rows; all other columns pass through (one of the same name as the result's is replaced).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed

TABLE_SIZE = 4_099
SHARDS = 64
SEED = "shard"


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard index of each slot; size must be prime, so that every step walks all slots."""
    if not shards or size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table needs a prime size of at least the number of shards")
    order = []
    for name in shards:
        h = hashlib.md5(name.encode()).digest()
        order.append((int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:], "big") % (size - 1) + 1))
    slots, at, left = [-1] * size, [0] * len(shards), size
    while left:
        for i, (offset, step) in enumerate(order):
            while slots[(offset + at[i] * step) % size] >= 0:
                at[i] += 1
            slots[(offset + at[i] * step) % size] = i
            left -= 1
            if not left:
                break
    return slots


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def assign_shards(docs: DataFrame, shards: int = SHARDS, size: int = TABLE_SIZE, id_col: str = "doc_id", seed: str = SEED) -> DataFrame:
    """docs with slot and shard; the broadcast side has `size` rows of two integers, whatever the data."""
    lookup = docs.sparkSession.createDataFrame(list(enumerate(fill(shard_names(shards), size))), "slot int, shard int")
    slotted = docs.drop("slot", "shard").withColumn("slot", F.pmod(keyed(seed, F.col(id_col)), F.lit(size)).cast("int"))
    return slotted.join(F.broadcast(lookup), "slot").select(*slotted.columns, "shard")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard; a shard of any size is split over tasks, not gathered in one."""
    assigned.repartition("shard", (F.rand(7) * 16).cast("int")).write.partitionBy("shard").parquet(path)


def oracle(shards: int = SHARDS, size: int = TABLE_SIZE, seed: str = SEED) -> str:
    slots = ", ".join(map(str, fill(shard_names(shards), size)))
    hashed = f"CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 15) AS BIGINT) % {size}"
    return f"WITH t AS (SELECT [{slots}] AS slots), d AS (SELECT doc_id, source, CAST({hashed} AS INTEGER) AS slot FROM documents) SELECT doc_id, source, slot, CAST(slots[slot + 1] AS INTEGER) AS shard FROM d, t"
