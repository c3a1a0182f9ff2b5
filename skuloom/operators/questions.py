"""The fixed questions asked of the telemetry table, and the best-model rule.

Lower rmse and mape and higher r2 are better. Models that could not be evaluated (NULL metrics) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuloom.functions.ranks import quantiles

GOOD_MAPE = 0.10


def known(error: Column | str) -> Column:
    """Whether an error can be compared: neither NULL nor NaN."""
    error = F.col(error) if isinstance(error, str) else error
    return error.isNotNull() & ~F.isnan(error)


def is_good(mape: Column | str = "mape") -> Column:
    """NULL and NaN are not good."""
    mape = F.col(mape) if isinstance(mape, str) else mape
    return mape < GOOD_MAPE


def skus_per_region(t: DataFrame) -> DataFrame:
    return t.groupBy("region").agg(F.count_distinct("sku").alias("skus"))


def highest_rmse(t: DataFrame, region: str, k: int = 10) -> DataFrame:
    rows = t.where((F.col("region") == region) & known("rmse"))
    return rows.orderBy(F.desc("rmse"), "sku", "model_name").select("sku", "model_name", "rmse").limit(k)


def lowest_rmse(t: DataFrame, region: str, k: int = 10) -> DataFrame:
    rows = t.where((F.col("region") == region) & known("rmse"))
    return rows.orderBy("rmse", "sku", "model_name").select("sku", "model_name", "rmse").limit(k)


def best_skus(t: DataFrame, region: str, k: int = 20) -> DataFrame:
    """Each sku by its best model."""
    best = best_models(t.where(F.col("region") == region))
    return best.orderBy("rmse", "sku").select("sku", "model_name", "rmse").limit(k)


def average_mape(t: DataFrame) -> DataFrame:
    return t.groupBy("region").agg(F.avg("mape").alias("avg_mape"))


def average_rmse(t: DataFrame) -> DataFrame:
    return t.groupBy("region").agg(F.avg("rmse").alias("avg_rmse")).orderBy("avg_rmse", "region")


def worst_r2(t: DataFrame, k: int = 10) -> DataFrame:
    return t.where(known("r2")).orderBy("r2", "region", "sku", "model_name").select("region", "sku", "model_name", "r2").limit(k)


def rmse_distributions(t: DataFrame, regions: list[str]) -> DataFrame:
    rows = t.where(F.col("region").isin(regions) & known("rmse")).select("region", "rmse")
    ranks = quantiles(rows, ["region"], "rmse", {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95})
    moments = rows.groupBy("region").agg(
        F.count("*").alias("models"),
        F.min("rmse").alias("min_rmse"),
        F.max("rmse").alias("max_rmse"),
        F.avg("rmse").alias("avg_rmse"),
        F.stddev("rmse").alias("std_rmse"),
    )
    return moments.join(ranks.drop("n"), "region")


def model_means(t: DataFrame) -> DataFrame:
    return t.groupBy("model_name").agg(F.avg("rmse").alias("mean_rmse"))


def best_model_overall(t: DataFrame) -> DataFrame:
    return model_means(t).where(F.col("mean_rmse").isNotNull()).orderBy("mean_rmse", "model_name").limit(1)


def _rank(error: str) -> Column:
    """Errors in ascending order with those that cannot be compared last; NaN sorts after every number."""
    return F.when(known(error), F.col(error)).otherwise(F.lit(float("nan")))


def best_models(t: DataFrame) -> DataFrame:
    """Best evaluated model per (region, sku): lowest rmse, then mape, then name.

    A minimum over a struct combines before the shuffle; a ranking window would move and sort every row.
    """
    order = F.struct(F.col("rmse").alias("a"), _rank("mape").alias("b"), "model_name", "rmse", "mape", "r2")
    return t.where(known("rmse")).groupBy("region", "sku").agg(F.min(order).alias("b")).select(
        "region", "sku", "b.model_name", "b.rmse", "b.mape", "b.r2"
    )


def default_models(t: DataFrame) -> DataFrame:
    """The model to serve per (region, sku): the best evaluated one, or the first by name where none was evaluated."""
    order = F.struct(_rank("rmse").alias("a"), _rank("mape").alias("b"), "model_name")
    return t.groupBy("region", "sku").agg(F.min(order)["model_name"].alias("model_name"))


def good_share(t: DataFrame) -> DataFrame:
    """Share of evaluated skus whose best model is under the threshold."""
    best = best_models(t)
    return best.agg(
        F.count("*").alias("skus"),
        F.count_if(is_good()).alias("good_skus"),
        F.try_divide(F.count_if(is_good()), F.count("*")).cast("double").alias("good_share"),
    )


def good_rows(t: DataFrame) -> DataFrame:
    """Rows and skus under the threshold, per region."""
    good = t.where(is_good())
    return good.groupBy("region").agg(F.count("*").alias("good_rows"), F.count_distinct("sku").alias("good_skus"))


def underperforming_regions(t: DataFrame) -> DataFrame:
    """Regions whose mean accuracy is below that of all rows; both come from the same per-region sums.

    The window runs over one row per region.
    """
    accuracy = F.col("metrics")["accuracy"]
    sums = t.groupBy("region").agg(F.sum(accuracy).alias("s"), F.count(accuracy).alias("n")).where("n > 0")
    everywhere = W.partitionBy()
    overall = F.sum("s").over(everywhere) / F.sum("n").over(everywhere)
    return sums.select("region", (F.col("s") / F.col("n")).alias("avg_accuracy"), overall.alias("overall_accuracy")).where(
        "avg_accuracy < overall_accuracy"
    )


def row_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("region").agg(F.count("*").alias("rows"))
