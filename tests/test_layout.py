"""Layout of the model bundle and lookups in it."""

import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
from plan_cases import fixture_plan, row_groups
from pyspark.sql import functions as F

from skuloom.functions import skus as S
from skuloom.operators import bundle, lookup


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """200 skus, 8 buckets, a plan read back from disk."""
    path = str(tmp_path_factory.mktemp("plan"))
    fixture_plan(spark, 200, 1, 1024, ["A", "B", "C"]).write.mode("overwrite").parquet(path)
    plan = spark.read.parquet(path)
    root = str(tmp_path_factory.mktemp("bundle")) + "/b"
    n = bundle.write_bundle(plan, root, 8, task_bytes=50 * 1024 * 1024)
    return plan, root, n


def test_every_bucket_has_a_file(spark, base):
    _, root, n = base
    files = {r["bucket"]: r["n"] for r in bundle.bundle_files(spark, root).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert sorted(files) == list(range(8)) and min(files.values()) >= 1 and n >= 8


def test_file_ranges_do_not_overlap(spark, tmp_path):
    plan = fixture_plan(spark, 400, 1, 1024, ["A", "B", "C"])
    bundle.write_bundle(plan, str(tmp_path / "b"), 4, task_bytes=10 * 1024)
    found = bundle.overlaps(bundle.file_ranges(spark, str(tmp_path / "b"))).collect()
    assert len(found) == 4
    assert max(r["files"] for r in found) >= 2
    assert all(r["overlaps"] == 0 for r in found)
    assert sum(r["n_rows"] for r in found) == 1200


def test_lookup_returns_the_stored_blobs(spark, base):
    plan, root, _ = base
    sku = "SKU-000123"
    got = lookup.lookup_one(bundle.read_bundle(spark, root), "REGION-00", sku, 8).collect()
    want = {r["model_name"]: bytes(r["model_blob_bytes"]) for r in plan.where(F.col("sku") == sku).collect()}
    assert {r["model_name"]: bytes(r["model_blob_bytes"]) for r in got} == want and len(want) == 3
    assert all(b.startswith(f"REGION-00|{sku}|{m}".encode()) and len(b) == 1024 for m, b in want.items())


def test_other_readers_find_the_row(base):
    _, root, _ = base
    table = ds.dataset(root, format="parquet", partitioning="hive").to_table(
        filter=(ds.field("bucket") == 123 % 8) & (ds.field("sku") == "SKU-000123"), columns=["model_blob_bytes"]
    )
    assert table.num_rows == 3


def test_lookup_prunes(spark, base):
    _, root, _ = base
    plan = lookup.lookup_one(bundle.read_bundle(spark, root), "REGION-00", "SKU-000123", 8)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "bucket" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(sku_n,123)" in text


def test_rewrite_leaves_nothing_stale(spark, tmp_path):
    root = str(tmp_path / "b")
    bundle.write_bundle(fixture_plan(spark, 100, 2, 64, ["A"]), root, 16)
    bundle.write_bundle(fixture_plan(spark, 20, 1, 64, ["A"]), root, 4)
    found = bundle.read_bundle(spark, root).groupBy("region").agg(F.count("*"), F.max("bucket")).orderBy("region").collect()
    assert [tuple(r) for r in found] == [("REGION-00", 20, 3), ("REGION-01", 100, 15)]


def test_many_lookups_find_every_sku_and_no_other(spark, tmp_path):
    plan = fixture_plan(spark, 500, 2, 2048, ["A", "B", "C"])
    root = str(tmp_path / "b")
    bundle.write_bundle(plan, root, 8, task_bytes=200_000, row_group_bytes=20_000)
    models = bundle.read_bundle(spark, root)
    found = lookup.lookup_many(models, plan, 8)
    same = found.join(plan.select("region", "sku", "model_name", F.col("model_blob_bytes").alias("want")), ["region", "sku", "model_name"])
    assert found.count() == 3000
    assert same.where(F.col("want") == F.col("model_blob_bytes")).count() == 3000
    # A number alone is not a sku.
    missing = spark.createDataFrame([("REGION-00", "SKU-000900"), ("REGION-00", "ALT-000003")], "region string, sku string")
    assert lookup.lookup_many(models, missing, 8).count() == 0
    asked = missing.unionByName(plan.select("region", "sku").limit(1))
    assert sorted(r["sku"] for r in lookup.unmatched(asked, plan).collect()) == ["ALT-000003", "SKU-000900"]


def test_row_groups_of_a_file_are_sorted(spark, tmp_path):
    bundle.write_bundle(fixture_plan(spark, 300, 1, 2048, ["A", "B"]).repartition(7), str(tmp_path / "b"), 2, row_group_bytes=20_000)
    groups = row_groups(tmp_path / "b")
    assert len(groups) > 20
    assert all(a[4] <= b[3] for a, b in zip(groups, groups[1:]) if a[0] == b[0])


def test_pieces_go_by_bytes(spark, tmp_path):
    """One region's blobs are fifty times larger: no file may exceed the bound by more than a sku."""
    small = fixture_plan(spark, 200, 1, 400, ["A"])
    large = fixture_plan(spark, 200, 2, 20_000, ["A"]).where("region = 'REGION-01'")
    bundle.write_bundle(small.unionByName(large), str(tmp_path / "b"), 2, task_bytes=200_000)
    sizes = bundle.read_bundle(spark, str(tmp_path / "b")).groupBy(F.col("_metadata.file_path")).agg(
        F.sum(F.octet_length("model_blob_bytes") + bundle.ROW_BYTES).alias("b")
    )
    assert sizes.agg(F.max("b")).first()[0] <= 200_000 + 21_000


def test_row_groups_keep_to_their_bytes(spark, tmp_path):
    """Blobs larger than a hundredth of a row group: the size must be checked before the hundredth row."""
    plan = fixture_plan(spark, 60, 1, 20_000, ["A", "B", "C"])
    root = str(tmp_path / "b")
    bundle.write_bundle(plan, root, 2, row_group_bytes=80_000)
    assert max(g[2] for g in row_groups(tmp_path / "b")) <= 8


def test_real_size_blobs(spark, tmp_path):
    """36 models of 4.4 MB that do not compress: about four to a row group of 16 MB."""

    def blobs(batches):
        for batch in batches:
            batch["model_blob_bytes"] = [np.random.RandomState(zlib.crc32(b)).bytes(4_400_000) for b in batch["model_blob_bytes"]]
            yield batch

    keys = fixture_plan(spark, 12, 1, 32, ["A", "B", "C"])
    keys.mapInPandas(blobs, keys.schema).write.parquet(str(tmp_path / "plan"))
    plan = spark.read.parquet(str(tmp_path / "plan"))
    root = str(tmp_path / "b")
    assert bundle.write_bundle(plan, root, 4, task_bytes=20 * 1024 * 1024) >= 7
    assert max(g[2] for g in row_groups(tmp_path / "b")) <= 5
    got = lookup.lookup_one(bundle.read_bundle(spark, root), "REGION-00", "SKU-000007", 4).select("model_name", F.md5("model_blob_bytes"))
    want = plan.where("sku = 'SKU-000007'").select("model_name", F.md5("model_blob_bytes"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ids_beyond_six_digits(spark, tmp_path):
    """String order and number order differ there: SKU-1000000 sorts before SKU-999999."""
    ids = spark.range(999_990, 1_000_030).select(S.sku_id(F.col("id")).alias("sku"))
    plan = ids.select(
        F.lit("R").alias("region"), "sku", F.lit("A").alias("model_name"), F.col("sku").cast("binary").alias("model_blob_bytes"),
        F.create_map(F.lit("a"), F.lit("b")).alias("params"), F.create_map(F.lit("rmse"), F.lit(0.1)).alias("metrics"),
    )
    root = str(tmp_path / "b")
    bundle.write_bundle(plan, root, 4, task_bytes=5_000)
    found = lookup.lookup_many(bundle.read_bundle(spark, root), plan, 4)
    assert found.where(F.col("model_blob_bytes").cast("string") == F.col("sku")).count() == 40


def test_a_sku_with_most_models_is_spread(spark, tmp_path):
    """One sku holds half the models: no file may hold them all, and nothing gets lost."""
    cold = fixture_plan(spark, 50, 1, 500, ["A", "B"])
    many = spark.range(100).select(
        F.lit("REGION-00").alias("region"), F.lit("SKU-000007").alias("sku"), F.concat(F.lit("M"), F.col("id")).alias("model_name"),
        F.rpad(F.col("id").cast("string"), 500, "y").cast("binary").alias("model_blob_bytes"),
        F.create_map(F.lit("a"), F.lit("b")).alias("params"), F.create_map(F.lit("rmse"), F.lit(0.1)).alias("metrics"),
    )
    root = str(tmp_path / "b")
    plan = cold.unionByName(many)
    bundle.write_bundle(plan, root, 2, task_bytes=10_000)
    files = bundle.file_ranges(spark, root)
    assert files.agg(F.sum("n_rows")).first()[0] == 200
    assert files.agg(F.max("n_rows")).first()[0] < 60
    assert bundle.audit(spark, root, plan, 2).where("NOT complete").count() == 0


def test_audit_sees_missing_rows(spark, base):
    plan, root, _ = base
    more = plan.unionByName(fixture_plan(spark, 201, 1, 8, ["A"]).where("sku = 'SKU-000200'"))
    bad = bundle.audit(spark, root, more, 8).where("NOT complete").collect()
    assert [(r["bucket"], r["plan_rows"] - r["bundle_rows"]) for r in bad] == [(0, 1)]


def test_region_names_are_kept_as_text(spark, tmp_path):
    root = str(tmp_path / "b")
    names = ["007", "A B", "x/y", "50%+1"]
    plan = fixture_plan(spark, 3, 4, 16, ["A"]).withColumn(
        "region", F.get(F.array(*[F.lit(n) for n in names]), F.substring_index("region", "-", -1).cast("int"))
    )
    bundle.write_bundle(plan, root, 2)
    assert {r[0] for r in bundle.read_bundle(spark, root).select("region").distinct().collect()} == set(names)
    assert {r[0] for r in bundle.bundle_files(spark, root).select("region").distinct().collect()} == set(names)


@pytest.mark.parametrize("n, want", [(1_000, 64), (10_000, 64), (20_000, 128), (100_000, 512), (1_500_000, 512)])
def test_bucket_count(spark, n, want):
    assert S.bucket_count(n) == want
    assert spark.range(1).select(S.bucket_count_col(F.lit(n))).first()[0] == want


def test_flat_bundle_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    root = tmp_path / "flat"
    bundle.write_flat(fixture_plan(spark, 300, 1, 8, ["A", "B"]), str(root))
    groups = [
        f.metadata.row_group(i).num_rows for p in root.rglob("*.parquet") for f in [pq.ParquetFile(p)] for i in range(f.num_row_groups)
    ]
    assert sum(groups) == 600 and max(groups) <= bundle.FLAT_ROW_GROUP_ROWS
    row = spark.read.parquet(str(root)).first()
    assert (row["rmse"], row["mape"], row["r2"]) == (0.1, 0.0, 0.0)
