"""The run hierarchy (region, sku, model, endpoint) as plain tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from skuloom.functions import skus as S
from skuloom.functions.ranks import SLICE_ROWS, sequence_numbers
from skuloom.session import checkpointed


def _tags(**values: Column | str) -> Column:
    return F.create_map(
        *[c for k, v in values.items() for c in (F.lit(k), F.lit(v) if isinstance(v, str) else v)]
    )


def region_runs(plan: DataFrame) -> DataFrame:
    region = F.col("region")
    return plan.select("region").distinct().select(
        S.run_id("region", region).alias("run_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("region").alias("layer"),
        S.region_run_name(region).alias("run_name"),
        S.experiment_name(region).alias("experiment"),
        _tags(layer="region", region=region).alias("tags"),
    )


def sku_runs(plan: DataFrame, n_shards: int = 1, count_models: bool = True) -> DataFrame:
    """One run per (region, sku). Grouping, not row order, brings a sku's rows together."""
    region, sku = F.col("region"), F.col("sku")
    shard = S.sku_shard(sku, n_shards)
    experiment = S.experiment_name(region) if n_shards <= 1 else S.shard_experiment_name(region, shard)
    tags = _tags(layer="sku", region=region, sku=sku)
    if count_models:
        tags = F.map_concat(tags, _tags(model_count=F.col("model_count").cast("string")))
    return plan.groupBy("region", "sku").agg(F.count_distinct("model_name").alias("model_count")).select(
        S.run_id("sku", region, sku).alias("run_id"),
        S.run_id("region", region).alias("parent_id"),
        F.lit("sku").alias("layer"),
        S.sku_run_name(sku).alias("run_name"),
        experiment.alias("experiment"),
        tags.alias("tags"),
    )


def model_runs(plan: DataFrame) -> DataFrame:
    """One run per model below its sku run: a projection, no shuffle."""
    region, sku, model = F.col("region"), F.col("sku"), F.col("model_name")
    return plan.select(
        S.run_id("model", region, sku, model).alias("run_id"),
        S.run_id("sku", region, sku).alias("parent_id"),
        F.lit("model").alias("layer"),
        S.model_run_name(sku, model).alias("run_name"),
        S.experiment_name(region).alias("experiment"),
        _tags(layer="model", region=region, sku=sku, model_name=model).alias("tags"),
    )


def collapsed_runs(plan: DataFrame, n_shards: int = 1) -> DataFrame:
    return region_runs(plan).unionByName(sku_runs(plan, n_shards))


def _plain_sku_runs(keys: DataFrame) -> DataFrame:
    region, sku = F.col("region"), F.col("sku")
    return keys.select(
        S.run_id("sku", region, sku).alias("run_id"),
        S.run_id("region", region).alias("parent_id"),
        F.lit("sku").alias("layer"),
        S.sku_run_name(sku).alias("run_name"),
        S.experiment_name(region).alias("experiment"),
        _tags(layer="sku", region=region, sku=sku).alias("tags"),
    )


def nested_runs(plan: DataFrame) -> DataFrame:
    """Region, sku and model runs. Model runs are a projection of the plan, which has one row per key (see
    :func:`duplicate_keys`); the levels above group one and two of its columns."""
    skus = _plain_sku_runs(plan.select("region", "sku").distinct())
    return region_runs(plan).unionByName(skus).unionByName(model_runs(plan))


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plan keys with marks at the first row of a region and at the first of a sku of each batch."""
    for batch in batches:
        keys = batch.select(["region", "sku"]).to_pandas()
        marks = [pa.array(~keys.duplicated(c).to_numpy()) for c in (["region"], ["region", "sku"])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [*batch.schema.names, "__region", "__sku"])


def run_rows(plan: DataFrame) -> DataFrame:
    """The runs of plan rows for streams, which drop those seen before: a region's and a sku's come again in every Arrow batch that has them."""
    plan = plan.select("region", "sku", "model_name")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema)
    plan = plan.mapInArrow(_first_rows, f"{ddl}, `__region` boolean, `__sku` boolean")
    region, sku, model = F.col("region"), F.col("sku"), F.col("model_name")

    def run(layer: str, run_id: Column, parent: Column, name: Column, tags: Column) -> Column:
        values = {"run_id": run_id, "parent_id": parent, "layer": F.lit(layer), "run_name": name, "experiment": S.experiment_name(region), "tags": tags}
        return F.struct(*[v.alias(c) for c, v in values.items()])

    region_id, sku_id = S.run_id("region", region), S.run_id("sku", region, sku)
    rows = F.array(
        F.when(F.col("__region"), run("region", region_id, F.lit(None).cast("string"), S.region_run_name(region), _tags(layer="region", region=region))),
        F.when(F.col("__sku"), run("sku", sku_id, region_id, S.sku_run_name(sku), _tags(layer="sku", region=region, sku=sku))),
        run(
            "model", S.run_id("model", region, sku, model), sku_id, S.model_run_name(sku, model),
            _tags(layer="model", region=region, sku=sku, model_name=model),
        ),
    )
    return plan.select(F.inline(F.array_compact(rows)))


def endpoint_runs(
    regions: DataFrame, n_endpoints: int, table_name: str, bundle_root: str, space_id: str = "", space_name: str = ""
) -> DataFrame:
    """``n_endpoints`` deployable runs per region, tagged with where the telemetry and the models are.

    The models are in ``folder``, if ``regions`` has it, else in the region's directory under ``bundle_root``.
    """
    region, index = F.col("region"), F.col("endpoint_index")
    folder = F.col("folder") if "folder" in regions.columns else F.concat(F.lit(bundle_root + "/region="), region)
    many = regions.select("region", folder.alias("folder")).withColumn(
        "endpoint_index", F.explode(F.sequence(F.lit(0), F.lit(max(1, n_endpoints) - 1)))
    )
    name = S.endpoint_run_name(region, index)
    return many.select(
        S.run_id("deployable_endpoint", region, index.cast("string")).alias("run_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("deployable_endpoint").alias("layer"),
        name.alias("run_name"),
        F.format_string("%s_endpoint_%02d", S.experiment_name(region), index).alias("experiment"),
        _tags(
            layer="deployable_endpoint",
            region=region,
            endpoint_index=index.cast("string"),
            demand_forecasting_table=table_name,
            model_bundle_uri=F.col("folder"),
            space_id=space_id,
            space_name=space_name,
        ).alias("tags"),
    )


def routes(keys: DataFrame, n_endpoints: int) -> DataFrame:
    """(region, sku) -> the endpoint that owns it."""
    index = S.sku_shard("sku", max(1, n_endpoints))
    return keys.select("region", "sku", index.alias("endpoint_index"),
                       S.endpoint_run_name(F.col("region"), index).alias("endpoint"))


def tags_long(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.explode("tags").alias("key", "value"))


def _entry_keys(plan: DataFrame, collapsed: bool) -> tuple[Column, Column]:
    region, sku, model = F.col("region"), F.col("sku"), F.col("model_name")
    if collapsed:
        return S.run_id("sku", region, sku), F.concat_ws(".", model, F.col("k"))
    return S.run_id("model", region, sku, model), F.col("k")


def run_params(plan: DataFrame, collapsed: bool) -> DataFrame:
    """One row per run parameter. Collapsed runs carry every model's under ``model.key``.

    Long rows instead of one map per sku: nothing is collected, however many models a sku has.
    """
    run, key = _entry_keys(plan, collapsed)
    return plan.select("region", "sku", "model_name", F.explode("params").alias("k", "v")).select(
        run.alias("run_id"), key.alias("key"), F.col("v").alias("value")
    )


def run_metrics(plan: DataFrame, collapsed: bool, logged_ms: Column | None = None) -> DataFrame:
    run, key = _entry_keys(plan, collapsed)
    at = F.unix_millis(F.current_timestamp()) if logged_ms is None else logged_ms
    return plan.select("region", "sku", "model_name", F.explode("metrics").alias("k", "v")).select(
        run.alias("run_id"),
        key.alias("key"),
        F.col("v").alias("value"),
        F.lit(0).cast("bigint").alias("step"),
        at.alias("logged_ms"),
    )


def prefixed(entries: Column, model: Column) -> Column:
    """A whole map with its keys put under the model's name."""
    return F.transform_keys(entries, lambda k, _: F.concat_ws(".", model, k))


def region_summaries(plan: DataFrame, bundle_root: str) -> DataFrame:
    """Region-only registration: one run per region with its model count and bundle."""
    return plan.groupBy("region").agg(F.count("*").cast("double").alias("model_count")).select(
        S.run_id("region", F.col("region")).alias("run_id"),
        "region",
        "model_count",
        F.concat(F.lit(bundle_root + "/region="), F.col("region")).alias("bundle_uri"),
    )


def shard_experiments(regions: DataFrame, n_shards: int) -> DataFrame:
    shard = F.explode(F.sequence(F.lit(0), F.lit(max(1, n_shards) - 1)))
    many = regions.select("region").withColumn("shard", shard)
    name = S.experiment_name(F.col("region")) if n_shards <= 1 else S.shard_experiment_name(F.col("region"), F.col("shard"))
    return many.select("region", "shard", name.alias("experiment"))


def not_registered(wanted: DataFrame, existing: DataFrame, key: str = "run_id") -> DataFrame:
    """Find-or-create: the rows still to be created.

    Existing ids are first cut down to the wanted ones: when those are few, Spark sends them to the large side and
    shuffles nothing of it; when they are many, both joins share one shuffle by id.
    """
    known = existing.select(key).join(wanted.select(key), key, "left_semi")
    return wanted.join(known, key, "left_anti")


def run_status(plan: DataFrame) -> DataFrame:
    """Status of every model run: FINISHED when the model could be evaluated, otherwise FAILED with the reason."""
    ok = F.try_element_at("metrics", F.lit("rmse")).isNotNull()
    return plan.select(
        "region",
        "sku",
        "model_name",
        S.run_id("model", F.col("region"), F.col("sku"), F.col("model_name")).alias("run_id"),
        F.when(ok, "FINISHED").otherwise("FAILED").alias("status"),
        F.when(~ok, F.concat_ws(": ", "region", F.concat(F.lit("no holdout rows for "), "sku"))).alias("error"),
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("region").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "FINISHED").alias("finished"),
        F.count_if(F.col("status") != "FINISHED").alias("failed"),
    )


def first_errors(status: DataFrame, k: int = 5) -> DataFrame:
    return status.where(F.col("error").isNotNull()).orderBy("region", "sku", "model_name").select(
        "region", "sku", "model_name", "error"
    ).limit(k)


def totals(runs: DataFrame) -> DataFrame:
    """Runs below region level and one artifact per region."""
    return runs.agg(
        F.count_if(F.col("layer") != "region").alias("total_runs"),
        F.count_if(F.col("layer") == "region").alias("total_artifacts"),
    )


def outcome(runs: DataFrame, status: DataFrame, strategy: str, seconds: float) -> DataFrame:
    """One row that sums up a registration, put together from two one-row aggregates."""
    failed = status.agg(F.count_if(F.col("status") != "FINISHED").alias("errors"))
    parts = totals(runs).unionByName(failed, allowMissingColumns=True)
    elapsed = F.lit(float(seconds))
    return parts.agg(*[F.max(c).alias(c) for c in ("total_runs", "total_artifacts", "errors")]).select(
        F.lit(strategy).alias("strategy"), "total_runs", "total_artifacts", elapsed.alias("elapsed_seconds"),
        S.throughput(F.col("total_runs"), elapsed).alias("throughput_runs_per_sec"), "errors",
    )


def outcome_payload(summary: DataFrame, errors: DataFrame, latencies: DataFrame) -> DataFrame:
    """``summary`` of :func:`outcome` with the first errors as a list and p50, p95 per lookup path.

    ``errors`` has a few rows (see :func:`first_errors`), ``latencies`` one per path (path, p50, p95).
    """
    listed = errors.agg(F.sort_array(F.collect_list("error")).alias("error_list"))
    paths = latencies.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", F.struct("p50", "p95"))))).alias("lookup_ms")
    )
    parts = summary.unionByName(listed, allowMissingColumns=True).unionByName(paths, allowMissingColumns=True)
    return parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])


def registered_against_expected(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Registered runs per (region, layer) next to ``expected`` (region, layer, expected_runs)."""
    found = runs.groupBy(F.col("tags")["region"].alias("region"), "layer").agg(F.count("*").alias("registered_runs"))
    return expected.join(found, ["region", "layer"], "full_outer").select(
        "region",
        "layer",
        F.coalesce("expected_runs", F.lit(0)).alias("expected_runs"),
        F.coalesce("registered_runs", F.lit(0)).alias("registered_runs"),
    ).withColumn("complete", F.col("expected_runs") == F.col("registered_runs"))


def duplicate_keys(plan: DataFrame) -> DataFrame:
    return plan.groupBy("region", "sku", "model_name").agg(F.count("*").alias("copies")).where("copies > 1")


def region_records(plan: DataFrame, region: str) -> DataFrame:
    """One region's records with their ``position`` in (sku number, model) order, from 1: an order across all tasks."""
    own = plan.where(F.col("region") == region).withColumn("sku_n", S.sku_number("sku"))
    order = ["sku_n", "sku", "model_name"]
    return sequence_numbers(own, ["region"], F.floor(F.col("sku_n") / F.lit(SLICE_ROWS)), order, "position").drop("sku_n")


def export_region(plan: DataFrame, region: str, consume: Callable[[Iterator[Row]], None]) -> None:
    """Hand one region's records to ``consume`` in order, range by range, on the executors.

    Every call gets consecutive positions. Calls run at the same time: a consumer that needs one order over all of them goes by
    ``position``, which starts a range exactly where the one before ends.
    """
    ordered = region_records(plan, region).repartitionByRange("position")
    ordered.sortWithinPartitions("position").foreachPartition(consume)


def export_region_in_turn(plan: DataFrame, region: str, consume: Callable[[Iterator[Row]], None], rows_per_range: int = 100_000) -> int:
    """One consumer gets a region's records in one order: range after range, each a job of its own whose one task calls ``consume``.

    The ranges are consecutive positions, so a range is all that a task holds; returns how many there were. A consumer that fails stops
    the export; positions say where it stood. A lost task is run again from the start of its range.
    """
    ordered = checkpointed(region_records(plan, region))
    last = ordered.agg(F.max("position")).first()[0] or 0
    ranges = range(0, last, rows_per_range)
    for begin in ranges:
        own = ordered.where((F.col("position") > begin) & (F.col("position") <= begin + rows_per_range))
        own.coalesce(1).sortWithinPartitions("position").foreachPartition(consume)
    return len(ranges)


def progress_marks(numbered: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th record of a numbered stream of records."""
    return numbered.where(F.col("rn") % every == 0)
