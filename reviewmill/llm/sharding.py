"""Shards by jump consistent hashing.

A document's shard follows from its id and the number of shards alone, without a table of the ring.
With one shard more, rows move only into the new one, and only their fair share of 1 / (n + 1).

Defined cases: a null id counts as the id -1; a null text has no bytes and the checksum 0; empty
tables give empty results; a repeated row gets a slot of its own. Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published algorithm: the 64-bit linear congruential generator's factor.
FACTOR = 2862933555777941757
MASK = 0xFFFFFFFF
PARTS = 1024
# Steps taken for every row; the few rows that need more go on, up to one step per shard.
STEPS = 48


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """Halves of (state * FACTOR + 1) mod 2**64, in products that stay below 2**63."""
    top, mid, bottom = FACTOR >> 32, FACTOR >> 16 & 0xFFFF, FACTOR & 0xFFFF
    by_mid = low * mid
    lower = low * bottom + 1 + by_mid.bitwiseAND(0xFFFF) * 65536
    product = (high * mid).bitwiseAND(0xFFFF) * 65536 + (high * bottom).bitwiseAND(MASK)
    upper = F.shiftright(lower, 32) + F.shiftright(by_mid, 16) + (low * top).bitwiseAND(MASK) + product
    return upper.bitwiseAND(MASK), lower.bitwiseAND(MASK)


def _state(key: Column, shards: int) -> Column:
    def jump(state: Column, _: Column) -> Column:
        high, low = _step(state["high"], state["low"])
        share = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            state["next"].alias("shard"),
            F.floor((state["next"] + 1).cast("double") * share).cast("bigint").alias("next"),
        )
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(MASK).alias("high"),
        key.bitwiseAND(MASK).alias("low"),
        F.lit(-1).cast("bigint").alias("shard"),
        F.lit(0).cast("bigint").alias("next"),
    )
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, STEPS))), start, jump)
    if shards > STEPS:
        rest = F.aggregate(F.sequence(F.lit(STEPS + 1), F.lit(shards)), state, jump)
        state = F.when(state["next"] < shards, rest).otherwise(state)
    return state


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a whole-number key."""
    if shards < 1:
        raise ValueError("at least one shard")
    return _state(F.coalesce(key.cast("bigint"), F.lit(-1)), shards)["shard"].cast("int")


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots number a shard's rows without gaps. A shard is cut into ``PARTS`` parts by its keys; parts
    are numbered on their own and begin where the parts before them end, so no task holds a shard.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1))
    part = F.shiftright(_step(F.shiftright(key, 32).bitwiseAND(MASK), key.bitwiseAND(MASK))[1], 22).cast("int")
    placed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("string").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        jump_shard(F.col(id_col), shards).alias("shard"),
        jump_shard(F.col(id_col), shards + 1).alias("grown_shard"),
        (part % PARTS).alias("part"),
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """Write the rows as Parquet, one folder ``shard=N`` for each shard."""
    docs.withColumn("shard", jump_shard(F.col(id_col), shards)).write.partitionBy("shard").parquet(path)
