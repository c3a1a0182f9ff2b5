"""Lookups that leave the stored models where they are."""

import re

import pytest
from plan_cases import fixture_plan
from pyspark.sql import functions as F

from skuloom.operators import shelf


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    plan = fixture_plan(spark, 60, 3, 64, ["A", "B", "C"])
    plan = plan.withColumn("metrics", F.create_map(F.lit("rmse"), F.when(F.col("sku") == "SKU-000005", None).otherwise(F.pmod(F.xxhash64("sku", "model_name"), F.lit(7)).cast("double"))))
    shelf.put(plan, "fixture_shelf", str(tmp_path_factory.mktemp("shelf") / "rows"), 6)
    return plan


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def requests(spark):
    rows = [(f"REGION-0{i % 4}", f"SKU-{i % 80:06d}") for i in range(200)] + [(None, "SKU-000001"), ("REGION-00", None)]
    return spark.createDataFrame(rows, "region string, sku string")


def moved(df):
    """Columns that every exchange of the plan takes in."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


def test_lookup_moves_no_blob(spark, stored, no_broadcast):
    found = shelf.lookup(spark, "fixture_shelf", requests(spark))
    exchanges = moved(found)
    assert exchanges and not [e for e in exchanges if "model_blob_bytes" in e]
    asked = {(r["region"], r["sku"]) for r in requests(spark).collect()}
    want = {(r["region"], r["sku"], r["model_name"], bytes(r["model_blob_bytes"])) for r in stored.collect() if (r["region"], r["sku"]) in asked}
    got = [(r["region"], r["sku"], r["model_name"], bytes(r["model_blob_bytes"])) for r in found.collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_model_is_chosen_before_a_blob_is_read(spark, stored, no_broadcast):
    picked = shelf.chosen(spark, "fixture_shelf", requests(spark))
    found = shelf.fetch(spark, "fixture_shelf", picked)
    assert not [e for e in moved(found) if "model_blob_bytes" in e]
    text = picked._jdf.queryExecution().executedPlan().toString()
    assert "model_blob_bytes" not in text
    best = {}
    for r in stored.collect():
        rmse = r["metrics"]["rmse"]
        rank = (rmse is None, rmse or 0.0, r["model_name"])
        best[r["region"], r["sku"]] = min(best.get((r["region"], r["sku"]), rank), rank)
    got = {(r["region"], r["sku"]): r["model_name"] for r in found.collect()}
    asked = {(r["region"], r["sku"]) for r in requests(spark).collect()}
    assert got == {k: v[2] for k, v in best.items() if k in asked} and ("REGION-02", "SKU-000005") not in asked or got


def test_buckets_by_bytes(spark):
    assert shelf.buckets_of(spark, "fixture_shelf") == 6
    assert shelf.shelf_buckets(0, 8) == 8 and shelf.shelf_buckets(100 * shelf.BUCKET_BYTES + 1, 8) == 101
