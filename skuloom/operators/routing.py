"""Which endpoint or shard owns a key: weighted rendezvous hashing, in expressions only.

Every owner draws a number for every key, from a hash of both; the highest draw, weighted, owns the key. A new owner takes keys only into
itself, a removed one's keys are the only ones that move, and shares follow weights. Owners are few and travel with the plan as an array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.functions import skus as S

#: Draws are numbers of 32 bits: the same digest gives them on any engine.
DRAW_BITS = 32


def draw(key: Column, owner: Column) -> Column:
    """Uniform in (0, 1): the first 32 bits of MD5 of key and owner."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, owner)), 1, DRAW_BITS // 4), 16, 10).cast("bigint")
    return (bits + 0.5) / float(1 << DRAW_BITS)


def owner_of(key: Column, owners: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """The owner with the least ``-ln(draw) / weight``; equal ones go to the first by name. Owners of weight 0 own nothing."""
    weights = [1.0] * len(owners) if weights is None else list(weights)
    given = [(o, w) for o, w in zip(owners, weights, strict=True) if w > 0]
    if not given:
        raise ValueError("no owner with a weight")
    array = F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(float(w)).alias("weight")) for o, w in given])
    drawn = F.transform(array, lambda o: F.struct((-F.ln(draw(key, o["owner"])) / o["weight"]).alias("at"), o["owner"].alias("owner")))
    return F.array_min(drawn)["owner"]


def endpoint_names(n: int) -> list[str]:
    return [f"{i:02d}" for i in range(n)]


def routes(keys: DataFrame, endpoints: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """(region, sku) and the endpoint of its region that owns it."""
    owner = owner_of(F.concat_ws("/", "region", "sku"), endpoints, weights)
    return keys.select("region", "sku", owner.alias("endpoint_index")).withColumn(
        "endpoint", F.concat("region", F.lit("_endpoint_"), "endpoint_index")
    )


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose endpoint differs, or that only one side has."""
    old = before.select("region", "sku", F.col("endpoint").alias("was"))
    both = old.join(after.select("region", "sku", F.col("endpoint").alias("now")), ["region", "sku"], "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def weighted_shard(sku: Column, shards: int) -> Column:
    """A sku's shard that one more shard takes away only for itself, unlike a remainder."""
    return owner_of(sku, endpoint_names(shards)).cast("int")


def shard_experiments(keys: DataFrame, shards: int) -> DataFrame:
    """(region, sku, shard, experiment) of sub-experiments by :func:`weighted_shard`."""
    shard = weighted_shard(F.col("sku"), shards)
    return keys.select("region", "sku", shard.alias("shard")).withColumn("experiment", S.shard_experiment_name(F.col("region"), F.col("shard")))


def bytes_per_endpoint(routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Keys and model bytes that each endpoint owns; ``sizes`` has (region, sku, bytes)."""
    return routed.join(sizes, ["region", "sku"], "left").groupBy("region", "endpoint").agg(
        F.count("*").alias("skus"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes")
    )
