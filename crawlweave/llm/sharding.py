"""Placement of rows on shards by a permutation-filled lookup table, in DataFrame operations only.

Each shard prefers the slots of a prime-sized table in its own order, offset + j * skip. Shards take turns
and claim their next free slot until the table is full, so shares differ by one slot at most, and losing
a shard moves few rows besides its own. The table (``slots`` rows, a fixed parameter) is broadcast; a row's
place costs one hash and one lookup, without a shuffle.

Defined cases: a null key has a place like any other value. Rows with equal keys share a shard. An empty
table stays empty. The result columns are added behind the columns of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
SLOTS = 2_039  # prime, and over 100 times the number of shards


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's slot order, from the MD5 of its name."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:12], 16) % slots, int(digest[12:24], 16) % (slots - 1) + 1


def fill_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Slot -> index of its shard."""
    if not shards or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("at least one shard and a prime number of slots are needed")
    orders = [preference(s, slots) for s in shards]
    nexts, table, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for i, (offset, skip) in enumerate(orders):
            while table[slot := (offset + nexts[i] * skip) % slots] >= 0:
                nexts[i] += 1
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot from the first 15 hexadecimal digits of the key's MD5; null has the slot of the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    rows = [(slot, i, shards[i]) for slot, i in enumerate(fill_table(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Input rows as ``row``, with ``slot``, ``shard`` and ``shard_name``."""
    rows = docs.select(F.struct("*").alias("row"), slot_of(F.col(key), slots).alias("slot"))
    return rows.join(F.broadcast(lookup_table(docs.sparkSession, shards, slots)), "slot").select("row", "slot", "shard", "shard_name")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """One folder per shard; the rebalance hint splits large shards and keeps small ones in few files."""
    placed = place(docs, key, shards, slots).select("row.*", F.col("shard_name").alias("_shard"))
    placed.hint("rebalance", "_shard").write.partitionBy("_shard").parquet(path)
