"""Run plans whose blobs start with their own key, so that a wrong-row lookup shows, and Parquet footers."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from skuloom.functions.skus import sku_id
from skuloom.sources.scaling import plan_keys


def fixture_plan(spark, n_skus, n_regions, blob_bytes, models):
    number = F.expr(f"cast(id div {n_skus} as int)")
    keys = spark.range(n_regions * n_skus).select(
        F.concat(F.lit("REGION-"), F.lpad(number.cast("string"), 2, "0")).alias("region"), sku_id(F.col("id") % n_skus).alias("sku")
    )
    own = F.concat_ws("|", "region", "sku", "model_name")
    return plan_keys(keys, models).select(
        "region",
        "sku",
        "model_name",
        F.rpad(own, blob_bytes, "x").cast("binary").alias("model_blob_bytes"),
        F.create_map(F.lit("learning_rate"), F.lit("0.01")).alias("params"),
        F.create_map(F.lit("rmse"), F.lit(0.1)).alias("metrics"),
    )


def row_groups(root):
    """(file, row group, rows, least and largest sku number) of every row group under ``root``."""
    out = []
    for path in sorted(root.rglob("*.parquet")):
        meta = pq.ParquetFile(path).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("sku_n")
        for i in range(meta.num_row_groups):
            g = meta.row_group(i)
            out.append((str(path), i, g.num_rows, g.column(at).statistics.min, g.column(at).statistics.max))
    return out
