"""Owners of keys, fingerprints of training rows, texts of older run plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skuloom.operators import fingerprints, routing
from skuloom.sources import older


def owned(spark, owners, weights=None, n=6000):
    keys = spark.range(n).select(F.lit("r").alias("region"), F.format_string("SKU-%06d", "id").alias("sku"))
    return {r["sku"]: r["endpoint_index"] for r in routing.routes(keys, owners, weights).collect()}


def test_a_new_owner_takes_keys_only_into_itself(spark):
    before, after = owned(spark, ["a", "b", "c"]), owned(spark, ["a", "b", "c", "d"])
    moved = {k for k in before if before[k] != after[k]}
    assert {after[k] for k in moved} == {"d"} and 1300 < len(moved) < 1700
    without = owned(spark, ["a", "c"])
    assert all(without[k] == before[k] for k in before if before[k] != "b")


def test_shares_follow_weights(spark):
    got = owned(spark, ["a", "b", "c", "d"], [1, 2, 3, 0])
    counts = [list(got.values()).count(o) for o in "abcd"]
    assert counts[3] == 0 and all(abs(c - 1000 * w) < 150 for c, w in zip(counts[:3], (1, 2, 3), strict=True))
    grown = owned(spark, ["a", "b", "c", "d"], [1, 2, 3, 2])
    assert {grown[k] for k in got if got[k] != grown[k]} == {"d"}
    with pytest.raises(ValueError):
        routing.owner_of(F.lit("k"), ["a"], [0])


def test_bytes_and_moves(spark):
    keys = spark.createDataFrame([("r", f"SKU-{i}") for i in range(50)] + [("r", None)], "region string, sku string")
    routed = routing.routes(keys, ["00", "01"])
    sizes = keys.select("region", "sku", F.lit(7).alias("bytes"))
    assert sum(r["bytes"] for r in routing.bytes_per_endpoint(routed, sizes).collect()) == 350
    assert routing.moved(routed, routed).where("sku is not null").count() == 0


ROWS = "region string, sku string, price double, day_of_week int, promotion boolean, inventory int, demand int, holdout boolean"


def test_fingerprints_see_contents_and_merge(spark):
    rng = random.Random(1)
    rows = [("r", f"s{i % 7}", rng.choice([1.5, None]), i % 7, None, i, i, False) for i in range(200)]
    df = spark.createDataFrame(rows, ROWS)
    whole = fingerprints.of_rows(df, fingerprints.TRAINED)
    parts = [fingerprints.of_rows(spark.createDataFrame(rows[k::3], ROWS), fingerprints.TRAINED) for k in range(3)]
    merged = fingerprints.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert fingerprints.keys_to_retrain(whole, merged).count() == 0
    other = list(rows)
    other[3] = (*other[3][:6], 999, False)  # same count, another demand
    other[5], other[12] = other[12], other[5]  # another order
    other = [r for r in other if r[1] != "s6"] + [("r", "s9", 1.0, 1, True, 1, 1, False)]
    now = fingerprints.of_rows(spark.createDataFrame(other, ROWS), fingerprints.TRAINED)
    changes = fingerprints.keys_to_retrain(whole, now)
    assert {(r["sku"], r["change"]) for r in changes.collect()} == {("s3", "changed"), ("s6", "gone"), ("s9", "new")}
    plan = spark.createDataFrame([("r", f"s{i}", "m") for i in range(7)], "region string, sku string, model_name string")
    assert {r["sku"] for r in fingerprints.reused(plan, changes).collect()} == {"s0", "s1", "s2", "s4", "s5"}
    twice = spark.createDataFrame([rows[0], rows[0]], ROWS)  # the xor of two equal rows is that of none
    assert fingerprints.keys_to_retrain(fingerprints.of_rows(twice, fingerprints.TRAINED), fingerprints.of_rows(twice.limit(0), fingerprints.TRAINED)).count() == 1


def test_older_texts(spark):
    texts = [
        json.dumps({"rmse": 1.5, "mape": "0.25", "other": [1]}), json.dumps({"metrics": {"rmse": 2}, "x": 1}), json.dumps({"rmse": {"value": 3}}),
        json.dumps({"mape": None}), "{}", None, '{"rmse": 1', "[1, 2]", "7", "", json.dumps({"rmse": "much"}),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    good, bad = older.decoded(rows, "text", ["rmse", "mape"])
    assert {r["n"]: r["metrics"] for r in good.collect()} == {
        0: {"rmse": 1.5, "mape": 0.25}, 1: {"rmse": 2.0}, 2: {"rmse": 3.0}, 3: {}, 4: {}, 5: {}, 10: {},
    }
    assert {r["n"]: r["reason"] for r in bad.collect()} == {6: "no JSON", 7: "no object", 8: "no object", 9: "no JSON"}
    assert good.columns == ["n", "text", "metrics"] and bad.columns == ["n", "text", "reason"]
