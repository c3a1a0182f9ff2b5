"""The model bundle: Parquet, one directory per (region, bucket), files and row groups sorted by sku."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuloom.functions import skus as S
from skuloom.functions.ranges import range_join
from skuloom.functions.ranks import SLICE_ROWS, running_totals
from skuloom.functions.skew import broadcast_if
from skuloom.session import checkpointed, fresh_path, materialize

BUNDLE_COLUMNS = ["sku", "sku_n", "model_name", "model_blob_bytes", "params", "metrics"]
BUNDLE_SCHEMA = (
    "sku string, sku_n bigint, model_name string, model_blob_bytes binary, params map<string,string>, "
    "metrics map<string,double>, region string, bucket int"
)
FLAT_METRICS = ["rmse", "mape", "r2"]
FLAT_ROW_GROUP_ROWS = 200
# Narrow rows, one or two per write task: a million of them describe two petabytes of 2 GB tasks.
BROADCAST_PIECES = 1_000_000
# What a row weighs besides its blob.
ROW_BYTES = 512


def row_bytes(plan: DataFrame) -> Column:
    """Bytes a plan row puts into the bundle. A stored ``blob_bytes`` column saves reading the blobs for it."""
    blob = F.col("blob_bytes") if "blob_bytes" in plan.columns else F.octet_length("model_blob_bytes")
    return F.coalesce(blob, F.lit(0)).cast("bigint") + ROW_BYTES


def bucketed(plan: DataFrame, buckets: int) -> DataFrame:
    return plan.withColumn("sku_n", S.sku_number("sku")).withColumn("bucket", S.sku_bucket("sku", buckets))


def write_pieces(counts: DataFrame, bytes_per_piece: int) -> DataFrame:
    """Cut the (region, bucket, sku) order into pieces of about ``bytes_per_piece`` bytes.

    From ``counts`` (region, bucket, sku_n, bytes): one row per piece and bucket with the sku range it covers there.
    The only window over a whole table runs over (region, bucket) totals: at most 512 rows per region.
    """
    totals = counts.groupBy("region", "bucket").agg(F.sum("bytes").alias("bytes"))
    earlier = W.orderBy("region", "bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("region", "bucket", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"))
    inside = running_totals(
        counts, ["region", "bucket"], F.floor(F.col("sku_n") / SLICE_ROWS), ["sku_n"], F.col("bytes"), "before"
    )
    piece = F.floor((F.col("start") + F.col("before")) / F.lit(bytes_per_piece)).alias("piece")
    return inside.join(starts, ["region", "bucket"]).groupBy("region", "bucket", piece).agg(
        F.min("sku_n").alias("sku_from"), F.max("sku_n").alias("sku_to")
    )


def write_bundle(
    plan: DataFrame, root: str, buckets: int, task_bytes: int = S.TASK_BYTES, row_group_bytes: int = S.ROW_GROUP_BYTES
) -> int:
    """Write the models of the regions at hand in one job; returns the number of write partitions.

    Each task gets one run of the (region, bucket, sku) order, cut at ``task_bytes`` by the bytes of its blobs, so every
    file of a bucket has its own sku range; the local sort gives every row group its own. The runs are counted from the key
    columns and blob sizes, and rows are sent to them by number: the blobs are shuffled once, with no sampling pass.
    A sku that alone exceeds a task is spread over several by model, any other sku stays in one.

    Other regions in ``root`` stay. Directories of the regions at hand are replaced, and those left from another
    layout are removed once the new ones are complete.
    """
    counts = materialize(
        bucketed(plan.select("region", "sku", row_bytes(plan).alias("bytes")), buckets)
        .groupBy("region", "bucket", "sku_n").agg(F.sum("bytes").alias("bytes")),
        fresh_path(plan.sparkSession, "bundle-counts"),
    )
    total = counts.agg(F.sum("bytes")).first()[0] or 0
    partitions = S.write_partitions(buckets, total, 1, task_bytes)
    bytes_per_piece = max(1, -(-total // partitions))
    pieces = checkpointed(write_pieces(counts, bytes_per_piece))
    hint = broadcast_if(pieces.count() <= BROADCAST_PIECES)
    # At most total / bytes_per_piece skus, i.e. no more than there are write partitions, exceed a piece.
    hot = counts.where(F.col("bytes") > bytes_per_piece).select(
        "region", "bucket", "sku_n", F.ceil(F.col("bytes") / F.lit(bytes_per_piece)).alias("spread")
    )
    part = F.when(
        F.col("spread").isNotNull(), F.pmod(F.xxhash64("model_name", "model_blob_bytes"), F.col("spread"))
    ).otherwise(F.lit(0))
    placed = range_join(
        bucketed(plan, buckets), pieces, ["region", "bucket"], "sku_n", "sku_from", "sku_to", how="left", hint=hint
    ).join(broadcast_if(hot.count() <= BROADCAST_PIECES)(hot), ["region", "bucket", "sku_n"], "left")
    (
        placed.withColumn("part", part)
        .withColumn("piece", (F.col("piece") + F.col("part")).cast("int"))
        # What follows from the sku is put back on the other side of the shuffle.
        .select("region", *[c for c in BUNDLE_COLUMNS if c != "sku_n"], "piece")
        .repartitionById(partitions, "piece")
        .transform(bucketed, buckets)
        .select("region", "bucket", *BUNDLE_COLUMNS)
        .sortWithinPartitions("region", "bucket", "sku_n", "model_name")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("region", "bucket")
        .option("parquet.block.size", str(row_group_bytes))
        # Without a check at every row, a row group never closes before its 100th row, however big the blobs.
        .option("parquet.page.size.row.check.min", "1")
        .option("parquet.page.size.row.check.max", "100")
        .parquet(root)
    )
    _remove_stale(counts, root)
    return partitions


def _remove_stale(counts: DataFrame, root: str) -> None:
    """Remove directories of the regions of ``counts`` whose bucket it does not fill: at most 512 for each region."""
    spark = counts.sparkSession
    held = bundle_files(spark, root).select("region", "bucket", F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    own = held.join(counts.select("region").distinct(), "region", "left_semi")
    stale = own.join(counts.select("region", "bucket").distinct(), ["region", "bucket"], "left_anti")
    for (folder,) in stale.select("folder").distinct().collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    """All models of a bundle; region and bucket come from the directory names, typed as declared."""
    return spark.read.schema(BUNDLE_SCHEMA).option("basePath", root).parquet(root)


def write_flat(plan: DataFrame, root: str) -> None:
    """Flat bundle per region: headline metrics as columns (0.0 when missing), 200 rows per row group."""
    flat = plan.select(
        "region",
        "sku",
        "model_name",
        F.col("model_blob_bytes").alias("model_blob"),
        *[F.coalesce(F.col("metrics")[k], F.lit(0.0)).alias(k) for k in FLAT_METRICS],
    )
    (
        # By region alone, so that a task writes one directory; adaptive execution splits big regions.
        flat.hint("rebalance", "region")
        .sortWithinPartitions("region", "sku", "model_name")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", "snappy")
        .option("parquet.block.row.count.limit", str(FLAT_ROW_GROUP_ROWS))
        .partitionBy("region")
        .parquet(root)
    )


def bundle_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, bytes, region, bucket) of every bundle file, from listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root)

    def in_path(name: str) -> Column:
        # Directory values are percent-escaped; a plus sign in them is a plus sign.
        value = F.regexp_extract("path", f"^.*/{name}=([^/]*)/", 1)
        return F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))

    return listed.select(
        F.col("path").alias("file"), F.col("length").alias("bytes"), in_path("region").alias("region"),
        in_path("bucket").cast("int").alias("bucket"),
    )


def file_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Rows and sku range per bundle file, from the data."""
    return read_bundle(spark, root).groupBy("region", "bucket", F.col("_metadata.file_path").alias("file")).agg(
        F.min("sku_n").alias("sku_min"), F.max("sku_n").alias("sku_max"), F.count("*").alias("n_rows")
    )


def overlaps(ranges: DataFrame) -> DataFrame:
    """Per (region, bucket): files, rows, and neighbouring files whose sku ranges touch.

    The window runs over files, not rows.
    """
    following = F.lead("sku_min").over(W.partitionBy("region", "bucket").orderBy("sku_min", "sku_max", "file"))
    return ranges.withColumn("next_min", following).groupBy("region", "bucket").agg(
        F.count("*").alias("files"),
        F.sum("n_rows").alias("n_rows"),
        F.count_if(F.col("next_min") <= F.col("sku_max")).alias("overlaps"),
    )


def audit(spark: SparkSession, root: str, plan: DataFrame, buckets: int) -> DataFrame:
    """Bundle against plan, per (region, bucket): rows and skus must agree and every filled bucket have a file."""
    wanted = bucketed(plan.select("region", "sku"), buckets).groupBy("region", "bucket").agg(
        F.count("*").alias("plan_rows"), F.count_distinct("sku").alias("plan_skus")
    )
    rows = read_bundle(spark, root).groupBy("region", "bucket").agg(
        F.count("*").alias("bundle_rows"), F.count_distinct("sku").alias("bundle_skus")
    )
    files = bundle_files(spark, root).groupBy("region", "bucket").agg(F.count("*").alias("files"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("plan_rows", "bundle_rows", "plan_skus", "bundle_skus", "files")]
    return (
        wanted.join(rows, ["region", "bucket"], "full_outer")
        .join(files, ["region", "bucket"], "full_outer")
        .select("region", "bucket", *zero)
        .withColumn(
            "complete",
            (F.col("plan_rows") == F.col("bundle_rows")) & (F.col("plan_skus") == F.col("bundle_skus")) & (F.col("files") > 0),
        )
    )
