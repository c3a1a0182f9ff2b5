"""Key grids, and bringing stored tables to a wanted number of skus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.functions.skus import expansion_partitions, rekeyed
from skuloom.sources import tables


def paired(skus: DataFrame, regions: list[str]) -> DataFrame:
    """Every region for every sku; regions are few and given by name."""
    return skus.withColumn("region", F.explode(F.array(*[F.lit(r) for r in regions])))


def plan_keys(pairs: DataFrame, model_names: list[str]) -> DataFrame:
    """Run-plan keys: each pair once per model name."""
    return pairs.withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in model_names])))


def further_copies(df: DataFrame, base_skus: int, target_skus: int) -> DataFrame | None:
    """The copies with shifted sku ids that ``df`` lacks to have ``target_skus`` in place of ``base_skus``, in one scan.

    None when the target is not a larger whole multiple of the base.
    """
    if base_skus <= 0 or target_skus <= base_skus or target_skus % base_skus:
        return None
    shift = F.explode(F.sequence(F.lit(1), F.lit(target_skus // base_skus - 1)))
    return df.withColumn("__copy", shift).withColumn(
        "sku", rekeyed("sku", F.col("__copy") * F.lit(base_skus).cast("bigint"))
    ).drop("__copy")


def expand(df: DataFrame, base_skus: int, target_skus: int) -> DataFrame | None:
    """``df`` with its further copies; see :func:`further_copies`. To grow a stored table, append those alone."""
    more = further_copies(df, base_skus, target_skus)
    return None if more is None else df.unionByName(more)


def existing_size(df: DataFrame) -> DataFrame:
    """(existing_rows, existing_skus) of a stored table, in one pass."""
    return df.agg(F.count("*").alias("existing_rows"), F.count_distinct("sku").alias("existing_skus"))


def scale_action(rows: Column, skus: Column, expected_rows: Column, target_skus: Column) -> Column:
    """Reuse where rows and skus are as wanted, expand where whole copies give both, rebuild otherwise."""
    copies = F.try_divide(target_skus, skus)
    return (
        F.when((rows == expected_rows) & (skus == target_skus), "reuse")
        .when((skus > 0) & (target_skus > skus) & (F.try_mod(target_skus, skus) == 0) & (rows * copies == expected_rows), "expand")
        .otherwise("rebuild")
    )


def bring_to_scale(
    spark: SparkSession,
    target: str,
    expected_rows: int,
    target_skus: int,
    build: Callable[[], DataFrame],
    partition_by: list[str] | None = None,
) -> str:
    """Reuse, expand or rebuild a stored table so that it has ``target_skus`` skus; returns what was done.

    Rows and distinct skus are compared, since directory and file counts look alike at different sizes. Expanding appends
    the missing copies, in as many tasks as their bytes ask for, and leaves the stored rows where they are.
    """
    action = "rebuild"
    if tables.exists(spark, target):
        stored = tables.read_any(spark, target)
        wanted = scale_action(F.col("existing_rows"), F.col("existing_skus"), F.lit(expected_rows), F.lit(target_skus))
        size = existing_size(stored).withColumn("action", wanted).first()
        action = size["action"]
    if action == "expand":
        more = further_copies(stored, size["existing_skus"], target_skus)
        # Bytes as stored, of the files that will be copied; a hot key's rows are spread by the copy they are in.
        copies = target_skus // size["existing_skus"] - 1
        held = stored.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct().agg(F.sum("b")).first()[0] or 0
        tasks = spark.range(1).select(expansion_partitions(spark.sparkContext.defaultParallelism, F.lit(held * copies))).first()[0]
        tables.append_any(more.repartition(int(tasks), *(partition_by or []), "sku"), target, partition_by)
    elif action == "rebuild":
        tables.write_any(build(), target, partition_by)
    return action
