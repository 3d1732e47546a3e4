"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of each slot.

    ``slots`` is a prime number, far above the number of shards. Each shard
    prefers the slots in an order of its own, given by a start and a step from its
    name's hash; the shards take turns, each claiming its first free slot. A shard
    that comes or goes moves few of the slots of the others.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or slots > 1 << 24:
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    hashes = [int(hashlib.md5(s.encode()).hexdigest(), 16) for s in shards]
    at = [(h >> 64) % slots for h in hashes]
    step = [h % (slots - 1) + 1 for h in hashes]
    table, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            if not free:
                break
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            table[at[shard]] = shard
            free -= 1
    return table


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """``slot`` and ``shard`` as a DataFrame, from one binary literal of two bytes a slot."""
    packed = F.lit(bytearray(b"".join(x.to_bytes(2, "big") for x in table)))
    return spark.range(0, len(table), 1, 1).select(F.col("id").alias("slot"), F.conv(F.hex(F.substring(packed, (2 * F.col("id") + 1).cast("int"), F.lit(2))), 16, 10).cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text; a null key counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint") % slots


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """Shard of every row of ``docs``.

    Returns ``doc_id`` (or what ``key`` names), ``slot`` and ``shard`` (its number), one
    row per row. Null keys share the slot of the empty text, equal keys share a slot,
    so repeated rows stay together. An empty table gives an empty result; other columns
    are not read. The table has ``slots`` rows whatever the input's size, so it is
    broadcast, and no row of ``docs`` is shuffled.
    """
    if len(shards or SHARDS) > 1 << 16:
        raise ValueError("at most 65536 shards")
    table = table_frame(docs.sparkSession, fill_table(shards or SHARDS, slots))
    return docs.select(key, slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(table), "slot").select(key, "slot", "shard")
