"""The demand table as a view over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.functions.skus import product_id, sku_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, region): the dimension chain is joined before it meets the fact table."""
    customers = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("region"))
    )
    return (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "region")
    )


def demand_from(lineitem: DataFrame, spark: SparkSession, sf_dir: str, inventory: bool = True) -> DataFrame:
    """Demand rows of the given line items, which may be a batch table or a stream."""
    rows = lineitem.join(order_regions(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    if inventory:
        parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("inventory"))
        rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    date = F.col("l_shipdate").cast("date")
    return rows.select(
        "region",
        sku_id(F.col("l_partkey")).alias("sku"),
        F.col("l_partkey").alias("sku_n"),
        date.alias("date"),
        product_id(F.col("l_partkey") % 50 + 1).alias("product_id"),
        F.col("l_quantity").cast("int").alias("demand"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.weekday(date).alias("day_of_week"),
        (F.col("l_discount") >= 0.08).alias("promotion"),
        *([F.col("inventory")] if inventory else []),
        (F.col("l_orderkey") % 5 == 0).alias("holdout"),
        F.col("l_orderkey").alias("order_no"),
        *[F.col(c) for c in lineitem.columns if c == "row_no"],
    )


def demand(spark: SparkSession, sf_dir: str, inventory: bool = True) -> DataFrame:
    """All demand rows. ``inventory=False`` leaves out the join with part when the column is not needed."""
    lineitem = table(spark, sf_dir, "lineitem").select("*", F.col("_metadata.row_index").alias("row_no"))
    return demand_from(lineitem, spark, sf_dir, inventory)
