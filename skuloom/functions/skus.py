"""SKU identifiers, buckets, shards, run names and task-sizing arithmetic, all as column expressions."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the bundle layout.
MIN_BUCKETS = 64
MAX_BUCKETS = 512
SKUS_PER_BUCKET = 156
ROW_GROUP_BYTES = 16 * 1024 * 1024
TASK_BYTES = 2 * 1024 * 1024 * 1024
EXPANSION_TASK_BYTES = 500 * 1024 * 1024


def padded(n: Column, digits: int) -> Column:
    """``n`` with leading zeros, longer numbers in full; far cheaper per row than a format string."""
    text = n.cast("bigint").cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))


def sku_id(n: Column) -> Column:
    return F.concat(F.lit("SKU-"), padded(n, 6))


def product_id(n: Column) -> Column:
    return F.concat(F.lit("PROD_"), padded(n, 3))


def sku_number(sku: Column | str) -> Column:
    """Numeric part after the last dash; right for any prefix and for ids of more than six digits."""
    sku = F.col(sku) if isinstance(sku, str) else sku
    return F.substring_index(sku, "-", -1).cast("bigint")


def sku_bucket(sku: Column | str, buckets: int | Column) -> Column:
    buckets = F.lit(buckets) if isinstance(buckets, int) else buckets
    return (sku_number(sku) % buckets).cast("int")


def position_bucket(sku: Column | str, buckets: int) -> Column:
    """Bucket by the digits from the fifth character on, as ids of the form ``SKU-<digits>`` have them."""
    sku = F.col(sku) if isinstance(sku, str) else sku
    return F.pmod(F.substring(sku, 5, 10).try_cast("bigint"), F.lit(buckets)).cast("int")


def sku_shard(sku: Column | str, shards: int) -> Column:
    """Stable over runs and machines, unlike a per-process string hash."""
    sku = F.col(sku) if isinstance(sku, str) else sku
    return F.pmod(F.crc32(sku.cast("binary")), F.lit(shards)).cast("int")


def rekeyed(sku: Column | str, offset: Column) -> Column:
    return sku_id(sku_number(sku) + offset)


def bucket_count(n_skus: int) -> int:
    return min(MAX_BUCKETS, max(MIN_BUCKETS, n_skus // SKUS_PER_BUCKET))


def bucket_count_col(n_skus: Column) -> Column:
    per = F.floor(n_skus / F.lit(SKUS_PER_BUCKET)).cast("int")
    return F.least(F.lit(MAX_BUCKETS), F.greatest(F.lit(MIN_BUCKETS), per))


def write_partitions(buckets: int, rows: int, bytes_per_row: float, task_bytes: int = TASK_BYTES) -> int:
    return max(buckets, ceil(rows * bytes_per_row / task_bytes))


def expansion_partitions(parallelism: int, total_bytes: Column) -> Column:
    return F.greatest(F.lit(2 * parallelism).cast("bigint"), F.ceil(total_bytes / F.lit(EXPANSION_TASK_BYTES)))


def run_id(*parts: Column | str) -> Column:
    """Deterministic 32-hex-digit id, so registering the same thing twice gives the same run."""
    return F.md5(F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def region_run_name(region: Column) -> Column:
    return F.concat(F.lit("region_"), region)


def sku_run_name(sku: Column) -> Column:
    return F.concat(F.lit("sku_"), sku)


def model_run_name(sku: Column, model: Column) -> Column:
    return F.concat_ws("_", sku, model)


def endpoint_run_name(region: Column, index: Column) -> Column:
    return F.format_string("%s_endpoint_%02d", region, index.cast("int"))


def experiment_name(region: Column, prefix: str = "Demand_Forecasting") -> Column:
    return F.concat(F.lit(prefix + "-"), region)


def shard_experiment_name(region: Column, shard: Column, prefix: str = "Demand_Forecasting") -> Column:
    return F.format_string(prefix + "-%s/shard_%02d", region, shard.cast("int"))


def throughput(runs: Column, seconds: Column) -> Column:
    return F.when(seconds == 0, F.lit(0.0)).otherwise(F.try_divide(runs.cast("double"), seconds))


def megabytes(n_bytes: Column) -> Column:
    return F.round(n_bytes / F.lit(1024.0 * 1024.0), 2)
