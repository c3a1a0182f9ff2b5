"""Streaming forms of scoring and registration, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.functions.skus import sku_id
from skuloom.plans.catalog import ORACLES, TELEMETRY, query, rounded
from skuloom.plans import latency_queries  # noqa: F401  (registers latency_batches)
from skuloom.plans.model_queries import SCORED, scored_columns
from skuloom.plans.registry_queries import KEYS, MODEL_RUNS, REGION_RUNS, SKU_RUNS
from skuloom.plans.store import ModelStore
from skuloom.session import fresh_path
from skuloom.sources import demand as D
from skuloom.streaming import latency, register, score


def scored_files(spark: SparkSession, sf_dir: str, served: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Line items read as a stream of files, turned into requests, scored and appended to files."""
    schema = D.table(spark, sf_dir, "lineitem").schema
    lineitem = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    asked = D.demand_from(lineitem, spark, sf_dir, inventory=False).where("holdout").select(
        "region", "sku", "price", "day_of_week", "promotion"
    )
    out = fresh_path(spark, "scores")
    scored = score.score_stream(asked, served, counts)
    score.to_files(scored, out + "/rows", out + "/checkpoint").awaitTermination()
    return spark.read.schema(scored.schema).parquet(out + "/rows")


@query("stream_scores", f"WITH {TELEMETRY} {SCORED}")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ModelStore(spark, sf_dir)
    counts = store.profile().select("region", sku_id(F.col("sku_n")).alias("sku"), F.col("n_holdout").alias("rows"))
    return scored_columns(scored_files(spark, sf_dir, store.served(), counts))


@query("stream_registration", f"WITH {KEYS} {REGION_RUNS} UNION ALL {SKU_RUNS} UNION ALL {MODEL_RUNS}")
def stream_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run plan registered as its files arrive; every run exists once at the end."""
    path, schema = ModelStore(spark, sf_dir).plan_path()
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    out = fresh_path(spark, "runs")
    register.register_stream(arriving, out + "/runs", out + "/checkpoint").awaitTermination()
    return register.registered(spark, out + "/runs").drop("tags")


@query("stream_latency_batches", ORACLES["latency_batches"])
def stream_latency_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive, in files of consecutive numbers: the open hundred of each type is the state between micro-batches."""
    events = D.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    out = fresh_path(spark, "latency")
    files = out + "/events"
    highest = events.agg(F.max("event_id")).first()[0] or 0
    for part in range(4):  # written one after the other, as a stream orders files by their time
        own = events.where(F.floor(F.col("event_id") * 4 / F.lit(highest + 1)) == part)
        own.coalesce(1).write.mode("append").parquet(files)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(files)
    stats = latency.batch_stats(arriving, ["phase"], "event_id", ["ms"])
    latency.to_files(stats, out + "/rows", out + "/checkpoint").awaitTermination()
    return rounded(spark.read.schema(stats.schema).parquet(out + "/rows"))
