"""Run hierarchy and its streaming form."""

import json

import pytest
from plan_cases import fixture_plan
from pyspark.sql import functions as F

from skuloom.operators import lookup, questions, registry
from skuloom.plans import registration
from skuloom import session
from skuloom.streaming import register, score


@pytest.fixture(scope="module")
def plan(spark, tmp_path_factory):
    """A plan whose skus are torn over many files, in no order."""
    path = str(tmp_path_factory.mktemp("plan"))
    fixture_plan(spark, 40, 2, 32, ["A", "B", "C"]).repartition(11, F.rand(1)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_one_run_per_sku_whatever_the_order(plan):
    runs = registry.collapsed_runs(plan)
    assert runs.groupBy("layer").count().collect().__len__() == 2
    skus = runs.where("layer = 'sku'")
    assert skus.count() == 80 and skus.select("run_id").distinct().count() == 80
    assert skus.where(F.col("tags")["model_count"] != "3").count() == 0


def test_nested_runs_form_a_tree(plan):
    runs = registry.nested_runs(plan)
    assert runs.count() == 2 + 80 + 240
    children = runs.where("parent_id IS NOT NULL").alias("c").join(runs.alias("p"), F.col("c.parent_id") == F.col("p.run_id"))
    pairs = {(r[0], r[1]): r[2] for r in children.groupBy("p.layer", "c.layer").count().collect()}
    assert pairs == {("region", "sku"): 80, ("sku", "model"): 240}


def test_long_entries(plan):
    assert registry.run_params(plan, collapsed=True).select("key").distinct().orderBy("key").collect()[0][0] == "A.learning_rate"
    m = registry.run_metrics(plan, collapsed=False, logged_ms=F.lit(5).cast("bigint"))
    assert m.count() == 240 and tuple(m.select("key", "value", "step", "logged_ms").first()) == ("rmse", 0.1, 0, 5)


def test_find_or_create(plan):
    runs = registry.nested_runs(plan)
    some = runs.where("layer <> 'model'")
    assert registry.not_registered(runs, some).count() == 240
    assert registry.not_registered(runs, runs).count() == 0


def test_duplicates_are_reported(plan):
    assert registry.duplicate_keys(plan).count() == 0
    assert registry.duplicate_keys(plan.unionByName(plan.limit(1))).count() == 1


def test_export_of_a_region_in_order(plan, tmp_path):
    folder = str(tmp_path)

    def consume(records):
        import json
        import uuid

        keys = [(r["sku"], r["model_name"], len(r["model_blob_bytes"])) for r in records]
        with open(f"{folder}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump(keys, f)

    registry.export_region(plan, "REGION-01", consume)
    parts = [[tuple(k) for k in json.loads(p.read_text())] for p in tmp_path.glob("*.json")]
    parts = sorted(p for p in parts if p)
    assert all(p == sorted(p) for p in parts)
    whole = [k for p in parts for k in p]
    assert whole == sorted(whole) and len(whole) == 120 and {k[2] for k in whole} == {32}


def test_one_consumer_gets_a_region_in_one_order(plan, tmp_path):
    target = str(tmp_path / "records")

    def consume(records):
        with open(target, "a") as f:
            f.writelines(f"{r['position']} {r['sku']} {r['model_name']}\n" for r in records)

    assert registry.export_region_in_turn(plan, "REGION-01", consume, rows_per_range=50) == 3
    lines = [x.split() for x in (tmp_path / "records").read_text().splitlines()]
    assert [int(x[0]) for x in lines] == list(range(1, 121)) and [x[1:] for x in lines] == sorted(x[1:] for x in lines)
    assert registry.export_region_in_turn(plan, "nowhere", consume) == 0


def test_shards_cover_every_sku(plan):
    runs = registry.sku_runs(plan, n_shards=4)
    per_sku = runs.select(F.col("tags")["sku"].alias("sku"), F.substring_index("experiment", "/", -1).alias("shard")).distinct()
    assert per_sku.count() == 40
    assert {r[0] for r in per_sku.select("shard").distinct().collect()} == {f"shard_0{i}" for i in range(4)}
    names = {r[0] for r in registry.shard_experiments(plan.select("region").distinct(), 1).select("experiment").collect()}
    assert names == {"Demand_Forecasting-REGION-00", "Demand_Forecasting-REGION-01"}


def test_status(spark, plan):
    broken = plan.withColumn("metrics", F.when(F.col("sku") == "SKU-000003", F.create_map().cast("map<string,double>")).otherwise(F.col("metrics")))
    status = registry.run_status(broken)
    assert {tuple(r) for r in registry.status_counts(status).collect()} == {("REGION-00", 120, 117, 3), ("REGION-01", 120, 117, 3)}
    assert [r["model_name"] for r in registry.first_errors(status).collect()] == ["A", "B", "C", "A", "B"]
    outcome = registry.outcome(registry.nested_runs(plan), status, "nested", 4.0).first()
    assert (outcome["total_runs"], outcome["throughput_runs_per_sec"], outcome["errors"]) == (320, 80.0, 6)


def test_streaming_registration_counts_every_run_once(spark, plan, tmp_path):
    source, runs, at = str(tmp_path / "in"), str(tmp_path / "runs"), str(tmp_path / "at")
    plan.repartition(4, F.rand(2)).write.parquet(source)

    def run():
        arriving = spark.readStream.schema(plan.schema).option("maxFilesPerTrigger", 1).parquet(source)
        register.register_stream(arriving, runs, at).awaitTermination()
        return register.registered(spark, runs)

    want = {r[0] for r in registry.nested_runs(plan).select("run_id").collect()}
    assert sorted(r[0] for r in run().select("run_id").collect()) == sorted(want)
    assert run().count() == len(want)
    more = fixture_plan(spark, 41, 2, 32, ["A", "B", "C"]).where("sku IN ('SKU-000040', 'SKU-000000')")
    more.coalesce(1).write.mode("append").parquet(source)
    after = run()
    assert after.count() == len(want) + 2 * (1 + 3) and after.select("run_id").distinct().count() == after.count()


def started(spark, plan, source, runs, at, files=1):
    arriving = spark.readStream.schema(plan.schema).option("maxFilesPerTrigger", files).parquet(source)
    query = register.register_stream(arriving, runs, at)
    query.awaitTermination()
    return query


def ids(spark, runs):
    return sorted(r[0] for r in register.registered(spark, runs).select("run_id").collect())


def test_a_replayed_batch_changes_nothing(spark, plan, tmp_path):
    source, runs, at = str(tmp_path / "in"), str(tmp_path / "runs"), str(tmp_path / "at")
    plan.repartition(3, F.rand(2)).write.parquet(source)
    started(spark, plan, source, runs, at)
    before = ids(spark, runs)
    assert len(before) == len(set(before)) == 322
    last = max((tmp_path / "at" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()  # as after a crash between a batch and its commit
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    started(spark, plan, source, runs, at)
    assert ids(spark, runs) == before


def test_a_batch_adds_its_changes_to_the_checkpoint(spark, plan, tmp_path):
    """Not the files of the state that it wrote anew; the session's own settings stay."""
    source, runs, at = str(tmp_path / "in"), str(tmp_path / "runs"), str(tmp_path / "at")
    plan.repartition(3, F.rand(2)).write.parquet(source)
    started(spark, plan, source, runs, at)
    state = [f.suffix for f in (tmp_path / "at" / "state").rglob("[0-9]*") if f.is_file()]
    assert state.count(".changelog") >= 3 and ".zip" not in state and ".sst" not in state
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", None) in (None, "false")


def test_fifty_batches_read_each_row_once(spark, plan, tmp_path):
    source, runs = str(tmp_path / "in"), str(tmp_path / "runs")
    plan.repartitionByRange(50, "sku", "model_name", "region").write.parquet(source)
    query = started(spark, plan, source, runs, str(tmp_path / "at"))
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) >= 45 and sum(p["numInputRows"] for p in progress) <= 240 + 1
    want = sorted(r[0] for r in registry.nested_runs(plan).select("run_id").collect())
    assert ids(spark, runs) == want


def test_a_second_checkpoint_keeps_all_runs(spark, plan, tmp_path):
    source, runs = str(tmp_path / "in"), str(tmp_path / "runs")
    plan.where("sku < 'SKU-000030'").repartition(2).write.parquet(source)
    started(spark, plan, source, runs, str(tmp_path / "first"))
    first = ids(spark, runs)
    more = fixture_plan(spark, 45, 2, 32, ["A", "B", "C"])
    more.where("sku >= 'SKU-000030'").repartition(3).write.mode("append").parquet(source)
    query = started(spark, plan, source, runs, str(tmp_path / "second"))
    want = sorted(r[0] for r in registry.nested_runs(more).select("run_id").collect())
    assert ids(spark, runs) == want and set(first) <= set(want)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 3
    assert spark.conf.get(session.STATE_PROVIDER, None) != session.ROCKS_DB


def test_streaming_scores_go_on_where_they_stopped(spark, tmp_path):
    models = spark.createDataFrame(
        [("r", "s", "mean", bytearray(b'{"kind":"mean","mean":4.5}'), {"rmse": 1.0})],
        "region string, sku string, model_name string, model_blob_bytes binary, metrics map<string,double>",
    )
    chosen = questions.default_models(registration.telemetry(models.withColumn("params", F.create_map().cast("map<string,string>"))))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    requests = spark.createDataFrame([("r", "s", 1.0, 2), ("r", "none", 1.0, 2)], "region string, sku string, price double, day_of_week int")
    for day in range(2):
        requests.coalesce(1).write.mode("append").parquet(source)
        asked = spark.readStream.schema(requests.schema).parquet(source)
        score.to_files(score.score_stream(asked, lookup.serving(models, chosen)), out, str(tmp_path / "at")).awaitTermination()
        got = spark.read.parquet(out).collect()
        assert [r["prediction"] for r in got] == [4.5] * (day + 1)
