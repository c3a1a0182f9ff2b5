"""Sharding through fixed virtual slots: records hash into slots, and a stored, versioned map takes slots to shards.

Only slots ever move. Bytes are summed per slot by Spark; the map has one entry per slot, so reading the sums,
editing the map and broadcasting it are bounded by SLOTS. Rows use DataFrame functions only.

Defined cases: a null text has no bytes (size 1) and the checksum of nothing (0); a null key is placed by its text;
repeated rows share a slot and get places of their own; an empty table keeps the even first map; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuloom.session import fresh_path, materialize

SLOTS = 4096
#: Rows that one task may number; more rows get more groups within a slot.
GROUP_ROWS = 100_000


def record_hash(key: str, text: str) -> Column:
    return F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(text))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size in bytes plus one, checksum, record hash and virtual slot of every row."""
    h = record_hash(key, text)
    return docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        h.alias("hash"),
        F.pmod(h, F.lit(SLOTS)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame) -> list[int]:
    """Bytes of every slot: at most SLOTS rows come to the driver."""
    sums = [0] * SLOTS
    for slot, size in rows.groupBy("virtual_slot").agg(F.sum("size")).collect():
        sums[slot] = size
    return sums


def even_map(shards: int) -> list[int]:
    """The first version: slot numbers dealt round."""
    return [slot % shards for slot in range(SLOTS)]


def rebalanced(shard_of: list[int], sizes: list[int], shards: int) -> list[int]:
    """Edit the map until no move or swap of one slot brings the largest and the smallest shard closer."""
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        held[shard].append((sizes[slot], slot))
    load = [sum(s for s, _ in own) for own in held]
    for own in held:
        own.sort()
    out = list(shard_of)
    while True:
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        best = None
        for size, slot in held[high]:
            # Against each slot, the one of the other shard (or none) that makes the exchange worth half the gap.
            i = bisect.bisect_left(held[low], (size - gap / 2, -1))
            for back in [(0, -1), *held[low][max(0, i - 1) : i + 1]]:
                moved = size - back[0]
                if 0 < moved < gap and (best is None or abs(2 * moved - gap) < best[0]):
                    best = (abs(2 * moved - gap), (size, slot), back)
        if best is None:
            return out
        _, there, back = best
        held[high].remove(there)
        bisect.insort(held[low], there)
        out[there[1]] = low
        if back[1] >= 0:
            held[low].remove(back)
            bisect.insort(held[high], back)
            out[back[1]] = high
        load[high] -= there[0] - back[0]
        load[low] += there[0] - back[0]


def grown(shard_of: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map for one more shard: slots only move into the new one, from the fullest shards, until it has its share."""
    load, share, out = [0] * shards, sum(sizes) / (shards + 1), list(shard_of)
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += sizes[slot]
        held[shard].append(slot)
    new = 0
    while any(held):
        high = max((s for s in range(shards) if held[s]), key=load.__getitem__)
        slot = held[high].pop()
        if new + sizes[slot] > share:
            if new + sizes[slot] - share < share - new:
                out[slot] = shards
            return out
        out[slot], new = shards, new + sizes[slot]
        load[high] -= sizes[slot]
    return out


def map_frame(spark: SparkSession, shard_of: list[int]) -> DataFrame:
    values = F.from_json(F.lit(json.dumps(shard_of)), "array<int>")
    return spark.range(1).select(F.posexplode(values).alias("virtual_slot", "shard"))


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """A version is written once and never changed."""
    map_frame(spark, shard_of).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of a version, the latest if none is named."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).drop("version")


def placed(rows: DataFrame, shard_map: DataFrame) -> DataFrame:
    """``rows`` of :func:`sized` with shard and place in it: 0, 1, 2 and so on without gaps.

    Rows are numbered in groups of about GROUP_ROWS within a slot; counts of the groups say where each begins.
    """
    total = rows.count()
    groups = max(1, -(-total // (SLOTS * GROUP_ROWS)))
    fine = F.pmod(F.shiftright("hash", 20), F.lit(groups)).cast("int")
    rows = rows.withColumn("__group", fine)
    counts = rows.groupBy("virtual_slot", "__group").agg(F.count("*").alias("__n"))
    earlier = W.rowsBetween(W.unboundedPreceding, -1)
    # SLOTS rows here at most.
    slots = counts.groupBy("virtual_slot").agg(F.sum("__n").alias("__n")).join(F.broadcast(shard_map), "virtual_slot")
    in_shard = F.coalesce(F.sum("__n").over(earlier.partitionBy("shard").orderBy("virtual_slot")), F.lit(0))
    slots = slots.select("virtual_slot", "shard", in_shard.alias("__before"))
    in_slot = F.coalesce(F.sum("__n").over(earlier.partitionBy("virtual_slot").orderBy("__group")), F.lit(0))
    begins = counts.select("virtual_slot", "__group", in_slot.alias("__inside")).join(F.broadcast(slots), "virtual_slot")
    number = F.row_number().over(W.partitionBy("virtual_slot", "__group").orderBy("key", "text_crc32", "size")) - 1
    out = rows.withColumn("__number", number).join(begins, ["virtual_slot", "__group"])
    slot = (F.col("__before") + F.col("__inside") + F.col("__number")).cast("bigint")
    return out.withColumn("slot", slot).select("key", "size", "text_crc32", "shard", "slot", "virtual_slot")


def shard(docs: DataFrame, shards: int, map_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard so that bytes are near equal; the map's versions are stored under ``map_path``.

    Version 1 deals slots round, version 2 is version 1 after rebalancing by the bytes found.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs, key, text), fresh_path(spark, "sized"))
    first = even_map(shards)
    save_map(spark, map_path, 1, first)
    save_map(spark, map_path, 2, rebalanced(first, slot_bytes(rows), shards))
    return placed(rows, load_map(spark, map_path, 2)).withColumnRenamed("key", key)
