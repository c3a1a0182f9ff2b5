"""Time the headline jobs on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.functions.skus import bucket_count
from skuloom.operators import bundle, latency, lookup, questions, registry, train, user_models
from skuloom.plans import model_queries, registration, source_queries, stream_queries
from skuloom.session import fresh_path, materialize
from skuloom.sources import demand as D
from skuloom.sources import scaling as G
from skuloom.sources import tables
from skuloom.streaming import register


def run(df: DataFrame) -> None:
    """Do all the work of a query and keep none of its rows."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()

    seconds: dict[str, float] = {}

    def timed(name: str, job: Callable[[], object]) -> object:
        began = time.perf_counter()
        result = job()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        return result

    path = fresh_path(spark, "bench")
    rows = D.demand(spark, sf_dir, inventory=False)

    def store_plan() -> None:
        tables.persist_run_plan(registration.train_plan(rows, path + "/profile"), path + "/plan")

    timed("demand_scan", lambda: run(D.demand(spark, sf_dir)))
    timed("train_and_evaluate", store_plan)
    plan = spark.read.parquet(path + "/plan")
    n_models = plan.count()
    buckets = bucket_count(plan.agg(F.count_distinct("sku")).first()[0])
    telemetry = registration.telemetry(plan).drop("logged_at")
    requests = model_queries.requests(spark, sf_dir)
    n_requests = requests.count()
    n_keys = requests.select("region", "sku").distinct().count()

    schema = source_queries.schema_for(spark, sf_dir)
    timed("telemetry_write", lambda: registration.write_telemetry(plan, f"{schema}.bench_telemetry"))
    timed("bundle_write", lambda: bundle.write_bundle(plan, path + "/bundle", buckets))
    timed("bundle_audit", lambda: run(bundle.audit(spark, path + "/bundle", plan, buckets)))
    models = bundle.read_bundle(spark, path + "/bundle")
    sample = [r["sku"] for r in lookup.sample_skus(plan.where("region = 'ASIA'"), 20, 42).collect()]

    def look_up(skus: list[str]) -> list[float]:
        taken = []
        for sku in skus:
            began = time.perf_counter()
            assert lookup.lookup_one(models, "ASIA", sku, buckets).collect()
            taken.append(1000 * (time.perf_counter() - began))
        return sorted(taken)

    cold = timed("lookup_20_cold", lambda: look_up(sample))
    timed("lookup_batch", lambda: run(lookup.lookup_many(models, requests, buckets)))
    timed("score_from_bundle", lambda: run(lookup.score_from_bundle(requests, models, buckets)))
    served = timed("serving_table", lambda: materialize(lookup.serving(plan, questions.default_models(telemetry)), path + "/served"))
    timed("score_requests", lambda: run(lookup.score(requests, served)))
    counts = materialize(requests.groupBy("region", "sku").agg(F.count("*").alias("rows")), path + "/counts")
    timed("score_stream", lambda: stream_queries.scored_files(spark, sf_dir, served, counts))
    timed("score_opaque", lambda: run(model_queries.score_requests_opaque(spark, sf_dir)))
    training = rows.where(~F.col("holdout")).select("region", "sku", "demand", "order_no", "row_no")
    timed("fit_groups", lambda: run(user_models.fit_groups(training, model_queries.DEMAND_TRAINER, ["row_no", "order_no"])))
    arriving = spark.readStream.schema(plan.schema).option("maxFilesPerTrigger", 8).parquet(path + "/plan")
    timed("register_stream", lambda: register.register_stream(arriving, path + "/runs", path + "/runs_at").awaitTermination())
    timed("question_average_rmse", lambda: run(questions.average_rmse(telemetry)))
    timed("question_best_models", lambda: run(questions.best_models(telemetry)))
    timed("question_top_rmse", lambda: run(questions.highest_rmse(telemetry, "ASIA")))
    timed("question_distributions", lambda: run(questions.rmse_distributions(telemetry, ["ASIA", "EUROPE"])))
    timed("register_nested", lambda: run(registry.nested_runs(plan)))
    timed("register_collapsed", lambda: run(registry.collapsed_runs(plan)))
    timed("run_metrics", lambda: run(registry.run_metrics(plan, collapsed=True)))
    events = D.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    timed("latency_batches", lambda: run(latency.batch_stats(events, ["phase"], "event_id", ["ms"])))
    timed("expand_plan", lambda: run(G.further_copies(plan, 10**6, 2 * 10**6)))
    timed("least_squares", lambda: run(user_models.solve_least_squares(user_models.moments(train.features(D.demand(spark, sf_dir))))))

    registration_seconds = seconds["telemetry_write"] + seconds["bundle_write"] + seconds["register_nested"]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir),
                "cpus": int(cpus),
                "models": n_models,
                "models_trained_per_sec": round(n_models / seconds["train_and_evaluate"]),
                "models_registered_per_sec": round(n_models / registration_seconds),
                "requests": n_requests,
                "lookup_cold_p50_ms": round(cold[10], 1),
                "lookup_cold_p95_ms": round(cold[19], 1),
                "bundle_buckets": buckets,
                "bundle_files": bundle.bundle_files(spark, path + "/bundle").count(),
                "batch_lookups_per_sec": round(n_keys / seconds["lookup_batch"]),
                "requests_scored_per_sec": round(n_requests / seconds["score_requests"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
