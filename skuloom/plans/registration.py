"""End-to-end registration: demand -> models -> run plan -> telemetry, bundle and run tables."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skuloom.functions.skus import bucket_count
from skuloom.operators import lookup, publish, registry, train
from skuloom.session import materialize
from skuloom.sources import schema, tables

BUCKETS_PROPERTY = "bucket_count"
BUNDLE_PROPERTY = "model_bundle_uri"
MANIFEST_PROPERTY = "model_bundle_manifest"
ERRORS_LISTED = 5
REGIONS_IN_PLACE = 32
TELEMETRY_COMMENT = "One row per trained model: settings and holdout metrics. The table properties name the bundle that holds the models."


def train_plan(demand: DataFrame, profile_path: str) -> DataFrame:
    """Run plan of the built-in models.

    The star join runs once: its narrow rows are stored, clustered by key, and both passes over them read that. The training
    sums are stored too; three later reads share them.
    """
    rows = materialize(train.narrow(demand).hint("rebalance", "region", "sku_n"), profile_path + "_rows")
    coefs = train.coefficients(materialize(train.profile(rows), profile_path))
    return train.run_plan(coefs, train.evaluate(rows, coefs))


def telemetry(plan: DataFrame) -> DataFrame:
    """Run plan without blobs, headline metrics as columns (NULL when absent), stamped with the load time."""
    return plan.select(
        "region",
        "sku",
        "model_name",
        *[F.col("metrics")[k].cast("double").alias(k) for k in ("rmse", "mape", "r2")],
        "params",
        "metrics",
        F.current_timestamp().alias("logged_at"),
    )


def write_telemetry(plan: DataFrame, name: str) -> None:
    spark = plan.sparkSession
    tables.ensure_table(spark, name, schema.TELEMETRY, ["region"], TELEMETRY_COMMENT)
    tables.replace_rows(tables.spread_by(telemetry(plan), "region"), name)


@dataclass(frozen=True)
class Registration:
    telemetry_table: str
    bundle_root: str
    manifest: str
    buckets: int
    endpoints: DataFrame
    outcome: DataFrame
    errors: DataFrame


OUTCOME = (
    "strategy string, total_runs bigint, total_artifacts bigint, elapsed_seconds double, throughput_runs_per_sec double, errors bigint, "
    "models bigint, model_bytes bigint, error_list array<string>, lookup_ms map<string,struct<p50:double,p95:double>>"
)


def register(
    plan: DataFrame, telemetry_table: str, bundle_root: str, n_endpoints: int = 3, outcomes: str | None = None, lookups: int = 0
) -> Registration:
    """Table-backed registration of a stored run plan: one bundle write, one telemetry write, few endpoint runs.

    All regions go through the same jobs; one that is unfit or fails becomes an error and keeps what it had before, in the
    bundle and in the telemetry table. Both switch to their new rows at once: the bundle by its manifest, the table by its location. The
    table's properties name the manifest and the bucket count, so a reader never has to guess the writer's.

    Models and failures are counted while the telemetry is written. The outcome, with the first errors and the times of ``lookups`` cold
    and as many warm lookups, is appended to ``outcomes`` if that is given.
    """
    spark = plan.sparkSession
    started = time.perf_counter()
    tables.ensure_table(spark, telemetry_table, schema.TELEMETRY, ["region"], TELEMETRY_COMMENT)
    n_skus = plan.agg(F.count_distinct("sku")).first()[0]
    buckets = bucket_count(n_skus)
    done = publish.publish(plan, bundle_root, buckets)
    fresh = telemetry(plan.where(F.col("region").isin(done.regions)))
    counted = Observation("telemetry")
    fresh = fresh.observe(counted, F.count("*").alias("models"), F.count_if(F.col("rmse").isNull()).alias("failed"))
    kept = spark.read.table(telemetry_table).where(~F.col("region").isin(done.regions))
    rows = fresh.unionByName(kept) if done.regions else kept
    # Few regions are written from where their rows lie, a file for each task and region; many are brought together first.
    tables.replace_rows(rows if len(done.regions) <= REGIONS_IN_PLACE else tables.spread_by(rows, "region"), telemetry_table)
    counts = counted.get if done.regions else {"models": 0, "failed": 0}
    tables.set_property(spark, telemetry_table, BUCKETS_PROPERTY, str(buckets))
    tables.set_property(spark, telemetry_table, BUNDLE_PROPERTY, bundle_root)
    tables.set_property(spark, telemetry_table, MANIFEST_PROPERTY, done.manifest)
    held = publish.current(spark, bundle_root, done.manifest)
    endpoints = registry.endpoint_runs(held.where(F.col("region").isin(done.regions)), n_endpoints, telemetry_table, bundle_root)
    seconds = time.perf_counter() - started

    n_runs, size = max(1, n_endpoints) * len(done.regions), held.where(F.col("region").isin(done.regions)).agg(F.sum("bytes")).first()[0]
    stored = spark.read.table(telemetry_table).where(F.col("region").isin(done.regions))
    first = registry.first_errors(registry.run_status(stored)) if counts["failed"] else None
    said = [f"{r.region}: {r.error}" for r in done.errors.orderBy("region").collect()] + [r.error for r in (first.collect() if first else [])]
    row = (
        "table", n_runs, len(done.regions), seconds, n_runs / seconds if seconds else 0.0, counts["failed"], counts["models"], size or 0,
        said[:ERRORS_LISTED], _lookup_times(spark, held, stored, bundle_root, done.manifest, lookups),
    )
    outcome = spark.createDataFrame([row], OUTCOME)
    if outcomes:
        tables.append_outcome(outcome, outcomes)
    return Registration(telemetry_table, bundle_root, done.manifest, buckets, endpoints, outcome, done.errors)


def _lookup_times(spark: SparkSession, held: DataFrame, stored: DataFrame, root: str, manifest: str, n: int) -> dict[str, tuple[float, float]]:
    """Nearest-rank p50 and p95 in ms of looking up ``n`` keys for the first time and the first of them ``n`` times more."""
    if not n:
        return {}
    buckets = {r["region"]: r["buckets"] for r in held.select("region", "buckets").collect()}
    keys = stored.select("region", "sku").distinct().orderBy(F.xxhash64("region", "sku"), "region", "sku").limit(n).collect()
    models = publish.models(spark, root, manifest)

    def timed(region: str, sku: str) -> float:
        began = time.perf_counter()
        lookup.lookup_one(models, region, sku, buckets[region]).select("model_blob_bytes").collect()
        return (time.perf_counter() - began) * 1000

    times = {"cold": [timed(*k) for k in keys], "warm": [timed(*keys[0]) for _ in keys]}
    return {path: tuple(sorted(ms)[min(len(ms) - 1, int(q * len(ms)))] for q in (0.5, 0.95)) for path, ms in times.items() if ms}


def stored_buckets(spark: SparkSession, telemetry_table: str) -> int:
    return int(tables.get_property(spark, telemetry_table, BUCKETS_PROPERTY))


def stored_models(spark: SparkSession, telemetry_table: str) -> DataFrame:
    """The models of a registration: the properties are read once, so later registrations do not change this DataFrame."""
    root, manifest = (tables.get_property(spark, telemetry_table, p) for p in (BUNDLE_PROPERTY, MANIFEST_PROPERTY))
    return publish.models(spark, root, manifest)
