"""What is shuffled and held: rows are moved before they are widened, and summed before they are copied."""

from datetime import date, datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plan_cases import fixture_plan
from skuloom.operators import lookup, registry, run_log, train, user_models
from skuloom.plans import registration, source_queries
from skuloom.session import fresh_path
from skuloom.sources import older, tables


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_keeps_one_mark_a_row(spark):
    rows = spark.createDataFrame(
        [("A", 1, 2, 1.0, 0, False, 7, 8, date(2024, 1, 1))],
        "region string, sku_n bigint, demand int, price double, day_of_week int, holdout boolean, order_no bigint, row_no bigint, date date",
    )
    assert train.narrow(rows).columns == ["region", "sku_n", "demand", "price", "day_of_week", "holdout", "row_no"]
    assert train.narrow(rows.drop("row_no")).columns[-1] == "order_no"


def test_clustered_plan_is_written_where_it_lies(spark, tmp_path):
    plan = fixture_plan(spark, 40, 2, 64, ["A", "B"]).repartition(3, "region", "sku")
    tables.persist_run_plan(plan, str(tmp_path / "plan"), clustered=True)
    stored = spark.read.parquet(str(tmp_path / "plan"))
    assert stored.select("region", "sku", "model_name").exceptAll(plan.select("region", "sku", "model_name")).isEmpty() and stored.count() == 160
    files = stored.select("region", "sku", F.input_file_name().alias("f")).distinct().groupBy("region", "sku").count()
    assert files.where("count > 1").isEmpty()


def test_runs_of_keys_over_batches():
    seen = []

    def of(key, group):
        seen.append(list(group.columns))
        return (*key, len(group))

    rows = pd.DataFrame({"k": ["a", "a", "b", "c", "c", "c", "d"], "n": [0, 0, 0, 0, 1, 1, 1], "v": range(7)})
    run = user_models._runs(["k", "n"], of, ["k", "n", "rows"], ["n"])
    for cuts in ([7], [1, 2, 5, 7], [0, 2, 4, 4, 6, 7]):
        got = pd.concat(run(iter([rows.iloc[a:b] for a, b in zip([0, *cuts], cuts)])))
        assert got.values.tolist() == [["a", 0, 2], ["b", 0, 1], ["c", 0, 1], ["c", 1, 2], ["d", 1, 1]]
    assert all(c == ["k", "v"] for c in seen)


def test_moments_bring_rows_together_first(spark):
    rows = spark.range(40).selectExpr(
        "'A' AS region", "concat('S', id % 3) AS sku", "double(id) AS price", "double(id % 7) AS day_of_week",
        "double(id % 2) AS promotion", "double(id % 5) AS inventory", "double(id * 2) AS demand",
    )
    sums = user_models.moments(rows)
    plan = executed(sums)
    assert "hashpartitioning(__spot" in plan and plan.count("hashpartitioning(") == 2  # rows by hash, then sums by key
    got = {r["sku"]: (r["n_rows"], r["mean_price"], round(r["price__demand"], 6)) for r in sums.collect()}
    x = rows.toPandas().groupby("sku")
    assert got == {k: (len(g), g.price.mean(), round(float(np.cov(g.price, g.demand, bias=True)[0, 1] * len(g)), 6)) for k, g in x}


def test_scores_read_blobs_without_maps_and_once(spark):
    plan = fixture_plan(spark, 20, 1, 64, ["A", "B"]).withColumn("sku_n", F.substring_index("sku", "-", -1).cast("bigint"))
    blob = F.to_json(F.struct(F.lit("mean").alias("kind"), F.col("sku_n").cast("double").alias("mean"))).cast("binary")
    rmse = F.create_map(F.lit("rmse"), F.when(F.col("model_name") == "B", 0.1).otherwise(0.2))
    models = plan.withColumns({"bucket": (F.col("sku_n") % 4).cast("int"), "model_blob_bytes": blob, "metrics": rmse})
    models = tables.stored_or_built(spark, fresh_path(spark, "models"), lambda: models)
    asked = spark.createDataFrame([("REGION-00", f"SKU-{k:06d}", 1.0, 0) for k in (3, 3, 7, 99)], "region string, sku string, price double, day_of_week int")
    scored = lookup.score_from_bundle(asked, models, 4)
    assert sorted((r["sku"], r["model_name"], r["prediction"]) for r in scored.collect()) == [
        ("SKU-000003", "B", 3.0), ("SKU-000003", "B", 3.0), ("SKU-000007", "B", 7.0)
    ]
    reads = [s.split("\n")[0] for s in executed(scored).split("ReadSchema: ")[1:]]
    assert {("model_blob_bytes" in s, "metrics" in s) for s in reads if "model_name" in s} == {(True, False), (False, True)}


def test_copies_are_made_of_counts(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("region", [(0, "ASIA")], "r_regionkey bigint, r_name string")
    put("nation", [(0, 0)], "n_nationkey bigint, n_regionkey bigint")
    put("customer", [(1, 0)], "c_custkey bigint, c_nationkey bigint")
    put("part", [(1, 5), (2, 6)], "p_partkey bigint, p_size int")
    put("orders", [(k, 1) for k in range(1, 7)], "o_orderkey bigint, o_custkey bigint")
    line = "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"
    put("lineitem", [(k, part, 2.0 * k, 10.0, 0.0, datetime(2024, 1, 1)) for k, part in [(1, 1), (2, 1), (3, 2), (4, None), (6, None)]], line)
    out = source_queries.expanded_demand(spark, str(tmp_path))
    got = {(r["sku"], r["row_count"], r["total_demand"]) for r in out.collect()}
    want = {(f"SKU-{n + 3 * c:06d}", rows, total) for c in range(3) for n, rows, total in ((1, 2, 6), (2, 1, 6))}
    assert got == want | {(None, 6, 60)} and out.count() == 7
    assert "l_orderkey" not in executed(out)


LOGGED = [("0123456789abcdef" * 2, 1), ("0123456789ABCDEF" * 2, 2), ("", 3), ("0" * 33, 4), ("é" * 16, 5), ("0" * 31 + "\n", 6), ("run-7", 7)]


def test_run_log_shuffles_events_once_in_a_compaction(spark, tmp_path):
    log, at = str(tmp_path / "log"), datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, None if n == 3 else "r", "RUNNING", None, at, n) for i, n in [*LOGGED, (None, 8)]], run_log.EVENTS)
    old = events.withColumn("range", run_log._range())  # as appends were laid out before
    old.write.partitionBy("range").parquet(f"{log}/events/part=0000000000000000")
    run_log.append(events, log)
    assert not [p for p in (tmp_path / "log/events").glob("part=*/range=*") if "0000000000000000" not in str(p)]
    newest = executed(run_log._folded(events))
    assert newest.count("Exchange") == 1 and "hashpartitioning(range" in newest
    expected = sorted((i, n) for i, n in LOGGED)
    for folded in (False, True):
        assert not folded or run_log.compact(spark, log) > 0
        now = run_log.current(spark, log)
        assert sorted((r["run_id"], r["seq"]) for r in now.collect()) == expected
        assert ("Exchange" in executed(now)) != folded  # the state has one row a run
    counted = run_log.history(spark, log).groupBy("run_id").count()
    assert executed(counted).count("Exchange") == 1 and {r["count"] for r in counted.collect()} == {1}


def test_older_texts_are_read_once(spark):
    rows = spark.createDataFrame([(1, '{"rmse": 1.5}'), (2, "[1]"), (3, None), (4, "{")], "n int, text string")
    every = older.judged(rows, "text", ["rmse"])
    assert {r["n"]: (r["metrics"], r["reason"]) for r in every.where("n in (1, 3)").collect()} == {1: ({"rmse": 1.5}, None), 3: ({}, None)}
    assert {r["n"]: r["reason"] for r in every.collect()} == {1: None, 2: "no object", 3: None, 4: "no JSON"}


def test_json_variants_reads_the_plan_once(spark):
    found = source_queries.json_variants(spark, "/root/testdata/sf0.001")
    assert executed(found).count("FileScan") == 1 and found.count() == 15


def test_a_stream_names_a_region_once_a_batch(spark):
    plan = spark.createDataFrame(
        [(r, s, m) for r in ("A", None) for s in ("S-1", "S-2") for m in ("x", "y", "z")], "region string, sku string, model_name string"
    ).coalesce(1)
    layers = {r["layer"]: r["count"] for r in registry.run_rows(plan).groupBy("layer").count().collect()}
    assert layers == {"region": 2, "sku": 4, "model": 12}
    runs = registry.nested_runs(plan.where("region = 'A'")).collect()
    assert sorted(map(str, registry.run_rows(plan.where("region = 'A'")).collect())) == sorted(map(str, runs))


def test_few_regions_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    spark.sql("CREATE SCHEMA IF NOT EXISTS volume")
    fixture_plan(spark, 6, 2, 64, ["A", "B"]).write.parquet(str(tmp_path / "plan"))
    plan, spread = spark.read.parquet(str(tmp_path / "plan")), []
    monkeypatch.setattr(tables, "spread_by", lambda df, *keys: spread.append(keys) or df.hint("rebalance", *keys))
    for limit, expected in ((32, []), (1, [("region",)])):
        monkeypatch.setattr(registration, "REGIONS_IN_PLACE", limit)
        registration.register(plan, f"volume.few_{limit}", str(tmp_path / f"bundle_{limit}"))
        assert spread == expected and spark.read.table(f"volume.few_{limit}").count() == 24
