"""Versions that readers see whole, regions that fail alone, status as a log."""

import datetime as dt
import random

import pytest
from plan_cases import fixture_plan
from pyspark.sql import functions as F

from skuloom.operators import publish, run_log
from skuloom.plans import registration
from skuloom.sources import snapshots, tables


@pytest.fixture(scope="module")
def schema_name(spark, tmp_path_factory):
    tables.create_schema(spark, "published", str(tmp_path_factory.mktemp("published")))
    return "published"


def numbers(spark, low, high):
    return spark.range(low, high).selectExpr("id AS a", "CAST(id % 2 AS STRING) AS part")


def rows_of(spark, name):
    return sorted(tuple(r) for r in spark.sql(f"SELECT a, part FROM {name}").collect())


def test_a_writer_that_dies_before_the_switch_leaves_the_old_rows(spark, schema_name):
    name = f"{schema_name}.numbers"
    assert snapshots.create(spark, name, "a BIGINT COMMENT 'it''s', part STRING", ["part"], "all 'numbers'")
    assert not snapshots.create(spark, name, "b INT", [])
    tables.replace_rows(numbers(spark, 0, 4), name)
    old = rows_of(spark, name)
    under_way = spark.read.table(name)
    staged = snapshots.stage(numbers(spark, 10, 12), name)  # the writer dies here
    assert rows_of(spark, name) == old == [(0, "0"), (1, "1"), (2, "0"), (3, "1")]
    with pytest.raises(Exception, match="boom"):
        tables.replace_rows(numbers(spark, 0, 9).withColumn("a", F.expr("CAST(raise_error('boom') AS BIGINT)")), name)
    broken = snapshots.location(spark, name).rsplit("/", 1)[0] + "/v-half"
    with pytest.raises(ValueError, match="not complete"):
        snapshots.switch(spark, name, broken)
    assert rows_of(spark, name) == old
    snapshots.switch(spark, name, staged)
    assert rows_of(spark, name) == [(10, "0"), (11, "1")]
    assert sorted(r["a"] for r in under_way.collect()) == [0, 1, 2, 3]
    plan = spark.sql(f"SELECT a FROM {name} WHERE part = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    fields = {f.name: f.metadata.get("comment") for f in spark.read.table(name).schema}
    assert fields["a"] == "it's" and tables.get_property(spark, name, snapshots.ROOT_PROPERTY)


def test_a_table_is_replaced_from_itself_and_old_versions_go(spark, schema_name):
    name = f"{schema_name}.itself"
    snapshots.create(spark, name, "a BIGINT, part STRING", [])
    for _ in range(3):
        tables.replace_from_itself(spark.read.table(name).unionByName(numbers(spark, 0, 2)), name)
    assert len(rows_of(spark, name)) == 6
    assert snapshots.drop_old_versions(spark, name, keep=1) >= 1
    assert len(rows_of(spark, name)) == 6 and len(snapshots.versions(spark, name)) == 2
    tables.append_any(numbers(spark, 7, 8), name)
    assert len(rows_of(spark, name)) == 7


def test_a_folder_is_swapped_and_a_swap_cut_short_is_finished(spark, tmp_path):
    path = str(tmp_path / "rows")
    numbers(spark, 0, 4).write.parquet(path)
    tables.replace_from_itself(tables.read_any(spark, path).where("a > 0"), path, ["part"])
    assert sorted(r["a"] for r in tables.read_any(spark, path).collect()) == [1, 2, 3]
    (tmp_path / "rows").rename(tmp_path / "rows__before")  # died between the two renames
    numbers(spark, 5, 6).write.parquet(path + "__next")
    assert [r["a"] for r in tables.read_any(spark, path).collect()] == [5]
    assert not (tmp_path / "rows__next").exists()


def held(spark, root):
    return {r["region"]: r["count"] for r in publish.models(spark, root).groupBy("region").count().collect()}


def poisoned(plan):
    """Region 1 names a model twice, region 2 has an sku without number and a model without bytes."""
    again = plan.where("region = 'REGION-01' AND sku = 'SKU-000003'").limit(1)
    two = F.col("region") == "REGION-02"
    bad = plan.withColumn("model_blob_bytes", F.when(two & (F.col("sku") == "SKU-000001"), F.lit(None)).otherwise(F.col("model_blob_bytes")))
    return bad.withColumn("sku", F.when(two & (F.col("sku") == "SKU-000002"), "SKU-ABC").otherwise(F.col("sku"))).unionByName(again)


def test_bad_regions_stay_behind(spark, tmp_path):
    root = str(tmp_path / "bundle")
    plan = fixture_plan(spark, 12, 3, 32, ["A", "B"])
    first = publish.publish(plan, root, 8)
    assert first.regions == ["REGION-00", "REGION-01", "REGION-02"] and first.errors.count() == 0
    before = publish.models(spark, root)
    more = fixture_plan(spark, 15, 3, 32, ["A", "B"])
    second = publish.publish(poisoned(more), root, 8)
    assert second.regions == ["REGION-00"]
    assert {tuple(r) for r in second.errors.collect()} == {
        ("REGION-01", "check", "1 keys that occur more than once"),
        ("REGION-02", "check", "2 rows without a model; 2 rows whose sku ends with no number"),
    }
    assert held(spark, root) == {"REGION-00": 30, "REGION-01": 24, "REGION-02": 24}
    assert before.count() == 72  # a reader keeps the manifest it began with
    third = publish.publish(more, root, 16)
    assert held(spark, root) == {f"REGION-0{i}": 30 for i in range(3)} and len(third.regions) == 3
    assert {r["buckets"] for r in publish.current(spark, root).collect()} == {16}
    assert publish.drop_unnamed(spark, root, keep=0) == 2 and held(spark, root)["REGION-01"] == 30


def test_a_region_whose_write_fails_stays_behind(spark, tmp_path):
    root = str(tmp_path / "bundle")
    plan = fixture_plan(spark, 6, 3, 32, ["A"])
    # Sizes can be read, the bytes themselves cannot.
    fails = F.when(F.col("region") == "REGION-01", F.raise_error(F.lit("cannot read this"))).otherwise(F.col("model_blob_bytes"))
    broken = plan.withColumn("blob_bytes", F.lit(32).cast("bigint")).withColumn("model_blob_bytes", fails.cast("binary"))
    done = publish.publish(broken, root, 8)
    assert done.regions == ["REGION-00", "REGION-02"] and held(spark, root) == {"REGION-00": 6, "REGION-02": 6}
    (error,) = done.errors.collect()
    assert error["region"] == "REGION-01" and error["stage"] == "write" and "cannot read this" in error["error"]


def test_a_publication_that_dies_leaves_the_manifest(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "bundle")
    publish.publish(fixture_plan(spark, 6, 2, 32, ["A"]), root, 8)
    monkeypatch.setattr(publish, "_next", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        publish.publish(fixture_plan(spark, 9, 2, 32, ["A"]), root, 8)
    assert held(spark, root) == {"REGION-00": 6, "REGION-01": 6}


def test_odd_region_names_and_rows_without_region(spark, tmp_path):
    root = str(tmp_path / "bundle")
    plan = fixture_plan(spark, 4, 2, 32, ["A"])
    plan = plan.withColumn("region", F.when(F.col("region") == "REGION-00", "a/b=c d%+é").otherwise(F.lit(None)))
    done = publish.publish(plan, root, 8)
    assert done.regions == ["a/b=c d%+é"] and held(spark, root) == {"a/b=c d%+é": 4}
    assert [tuple(r) for r in done.errors.collect()] == [(publish.NO_REGION, "check", "4 rows without region")]
    assert publish.publish(plan.where("false"), root, 8).regions == [] and held(spark, root) == {"a/b=c d%+é": 4}


def test_registration_keeps_what_bad_regions_had(spark, schema_name, tmp_path):
    name, root = f"{schema_name}.telemetry", str(tmp_path / "bundle")
    registration.register(fixture_plan(spark, 12, 3, 32, ["A", "B"]), name, root)
    plan = poisoned(fixture_plan(spark, 15, 3, 32, ["A", "B"]))
    done = registration.register(plan, name, root, outcomes=str(tmp_path / "outcomes"), lookups=2)
    counts = {r["region"]: r["count"] for r in spark.read.table(name).groupBy("region").count().collect()}
    assert counts == {"REGION-00": 30, "REGION-01": 24, "REGION-02": 24} == held(spark, root)
    assert registration.stored_models(spark, name).count() == 78
    outcome = done.outcome.first()
    assert (outcome["total_artifacts"], outcome["models"], outcome["model_bytes"]) == (1, 30, 30 * 32)
    assert outcome["error_list"][0].startswith("REGION-01: 1 keys") and set(outcome["lookup_ms"]) == {"cold", "warm"}
    payload = spark.read.parquet(str(tmp_path / "outcomes")).first()[0]
    assert "REGION-02: 2 rows without a model" in payload and '"cold"' in payload


def events(spark, rows):
    return spark.createDataFrame(rows, run_log.EVENTS)


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


@pytest.mark.parametrize("seed", [1, 2])
def test_status_is_the_latest_event_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = str(tmp_path / "log")
    rows = [(f"run-{rng.randint(0, 40)}", "r", rng.choice(["RUNNING", "FINISHED", "FAILED"]), None, at(rng.randint(0, 5)), rng.randint(0, 3)) for _ in range(300)]
    rows += [(None, "r", "FAILED", None, at(9), 1)]
    want = {}
    for r in rows:
        if r[0] is not None and (r[0] not in want or (r[4], r[5], r[2]) > (want[r[0]][4], want[r[0]][5], want[r[0]][2])):
            want[r[0]] = r
    rng.shuffle(rows)
    for k in range(0, len(rows), 101):
        run_log.append(events(spark, rows[k : k + 101]), log)
        run_log.append(events(spark, rows[k : k + 20]), log)  # repeated
        if k != 101:
            run_log.compact(spark, log)
    got = {r["run_id"]: tuple(r) for r in run_log.current(spark, log).collect()}
    assert got == want
    assert run_log.history(spark, log).count() == len({r for r in rows if r[0] is not None})


def test_compaction_touches_only_ranges_with_events(spark, tmp_path):
    log = str(tmp_path / "log")
    run_log.append(events(spark, [(f"run-{i}", "r", "RUNNING", None, at(0), 0) for i in range(500)]), log)
    assert run_log.compact(spark, log) == run_log.RANGES and run_log.compact(spark, log) == 0
    run_log.append(events(spark, [("run-7", "r", "FINISHED", None, at(1), 0)]), log)
    assert run_log.compact(spark, log) == 1
    run_log.append(run_log.terminated(run_log.current(spark, log), F.lit(at(2)), F.lit(0)), log)
    counts = {r["status"]: r["count"] for r in run_log.current(spark, log).groupBy("status").count().collect()}
    assert counts == {"FINISHED": 1, "FAILED": 499}


def test_an_empty_log(spark, tmp_path):
    assert run_log.current(spark, str(tmp_path / "none")).count() == 0 and run_log.compact(spark, str(tmp_path / "none")) == 0
