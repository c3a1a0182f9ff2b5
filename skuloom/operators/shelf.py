"""Models on a shelf: a bucketed, sorted table that lookups read where it lies, without moving a blob.

The bundle is laid out for pruning: one directory per region and bucket. Asking it for very many keys at once shuffles what
it returns, blobs included. The shelf holds the same rows hashed by (region, sku) into a fixed number of buckets. A batch of keys is hashed the same way
and comes to the shelf; the model of each key is chosen from the narrow columns first, so a blob is read from its file only if it is served.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.operators import questions, train
from skuloom.sources.files import get_property, quoted

KEYS = ["region", "sku"]
BUCKETS_PROPERTY = "shelf_buckets"
#: Bytes of a bucket: it is what one task reads.
BUCKET_BYTES = 2 << 30


def shelf_buckets(total_bytes: int, parallelism: int) -> int:
    """Enough for every core, and for buckets of ``BUCKET_BYTES``."""
    return max(1, parallelism, -(-total_bytes // BUCKET_BYTES))


def put(models: DataFrame, name: str, path: str, buckets: int) -> None:
    """Store models (region, sku, model_name, model_blob_bytes, metrics, ...) as the table ``name`` in ``path``.

    Rows are hashed once to their bucket, so each bucket is one file; a bucket is sorted by key, and its row groups are cut by bytes.
    """
    rows = models.withColumn("rmse", F.col("metrics")["rmse"]).withColumn("mape", F.col("metrics")["mape"])
    columns = [*KEYS, "model_name", "rmse", "mape", "model_blob_bytes"]
    (
        rows.select(*columns)
        .repartition(buckets, *KEYS)
        .write.mode("overwrite")
        .bucketBy(buckets, *KEYS)
        .sortBy(*KEYS, "model_name")
        .option("path", path)
        .option("parquet.block.size", str(16 << 20))
        .option("parquet.page.size.row.check.min", "1")
        .option("parquet.page.size.row.check.max", "100")
        .saveAsTable(name)
    )
    spark = models.sparkSession
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{BUCKETS_PROPERTY}' = '{quoted(str(buckets))}')")


def buckets_of(spark: SparkSession, name: str) -> int:
    return int(get_property(spark, name, BUCKETS_PROPERTY))


def _arranged(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.repartition(buckets, *KEYS)


def chosen(spark: SparkSession, name: str, requests: DataFrame) -> DataFrame:
    """The model to serve for each requested key, see :func:`skuloom.operators.questions.default_models`, from narrow columns."""
    wanted = _arranged(requests.select(*KEYS).distinct(), buckets_of(spark, name))
    narrow = spark.read.table(name).select(*KEYS, "model_name", "rmse", "mape").hint("merge")
    return questions.default_models(narrow.join(wanted, KEYS, "left_semi"))


def fetch(spark: SparkSession, name: str, picked: DataFrame, best: bool = True) -> DataFrame:
    """The models of the picked keys, of the picked names if ``best``: the picked rows come to the shelf, its rows stay where they are.

    The name is compared after the join by key: as a part of the join it would ask for another distribution than the shelf has.
    """
    few = _arranged(picked.select(*KEYS, *([F.array("model_name").alias("__names")] if best else [])), buckets_of(spark, name))
    models = spark.read.table(name).hint("merge")
    found = models.join(few, KEYS)
    return found.where(F.array_contains("__names", F.col("model_name"))).drop("__names") if best else found


def lookup(spark: SparkSession, name: str, requests: DataFrame) -> DataFrame:
    """All models of the requested keys."""
    return fetch(spark, name, requests.select(*KEYS).distinct(), best=False)


def score(spark: SparkSession, name: str, requests: DataFrame) -> DataFrame:
    """Predict requests with the best model of each key, decoded once per key; keys that nobody has are left out."""
    served = fetch(spark, name, chosen(spark, name, requests)).select(*KEYS, "model_name", train.decoded(F.col("model_blob_bytes")).alias("model"))
    return requests.join(served, KEYS).withColumn("prediction", train.predict(F.col("model"))).drop("model")
