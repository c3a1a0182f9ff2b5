"""Schemas, tables and scaling."""

import pytest
from plan_cases import fixture_plan
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.functions import skus as S
from skuloom.plans import registration
from skuloom.sources import scaling as G
from skuloom.sources import schema, tables


def test_definitions(spark):
    telemetry = schema.columns_of(schema.TELEMETRY)
    assert [f.name for f in telemetry][:4] == ["region", "sku", "model_name", "rmse"]
    assert telemetry["metrics"].dataType == T.MapType(T.StringType(), T.DoubleType(), True)
    assert all(f.metadata["comment"] for f in telemetry)
    demand = schema.columns_of(schema.DEMAND)
    assert demand["date"].dataType == T.DateType() and not demand["price"].nullable


def test_conform_and_violations(spark):
    df = spark.createDataFrame([("1", None), ("2", "x")], "b string, a string")
    ddl = "a string not null, b int not null"
    assert schema.conform(df, ddl).dtypes == [("a", "string"), ("b", "int")]
    assert {r[0]: r[1] for r in schema.null_violations(schema.conform(df, ddl), ddl).collect()} == {"a": 1, "b": 0}


def test_sizing(spark):
    assert S.write_partitions(64, 30_000, 4_400_000) == 64
    assert S.write_partitions(64, 60_000, 4_400_000) == 123
    sizes = [S.expansion_partitions(8, F.lit(b)) for b in (100, 500 * 1024 * 1024 * 40, 500 * 1024 * 1024 * 40 + 1)]
    assert tuple(spark.range(1).select(*sizes).first()) == (16, 40, 41)


def test_throughput(spark):
    r = spark.range(1).select(S.throughput(F.lit(10), F.lit(4.0)), S.throughput(F.lit(10), F.lit(0.0))).first()
    assert tuple(r) == (2.5, 0.0)


def test_sku_functions(spark):
    df = spark.createDataFrame([("SKU-000130",), ("SKU-1000001",), ("X-Y-7",)], "sku string")
    got = df.select(S.sku_number("sku"), S.sku_bucket("sku", 64), S.rekeyed("sku", F.lit(10))).collect()
    assert [tuple(r) for r in got] == [(130, 2, "SKU-000140"), (1000001, 1000001 % 64, "SKU-1000011"), (7, 7, "SKU-000017")]


def test_expansion(spark):
    plan = fixture_plan(spark, 10, 2, 32, ["A", "B"])
    grown = G.expand(plan, 10, 30)
    assert grown.count() == 3 * plan.count()
    assert grown.select("region", "sku", "model_name").distinct().count() == 120
    assert {r[0] for r in grown.select("sku").distinct().collect()} == {f"SKU-{i:06d}" for i in range(30)}
    assert G.further_copies(plan, 10, 30).count() == 2 * plan.count() and G.further_copies(plan, 0, 30) is None
    assert G.expand(plan, 10, 10) is None and G.expand(plan, 10, 5) is None and G.expand(plan, 10, 25) is None


@pytest.fixture(scope="module")
def schema_name(spark, tmp_path_factory):
    tables.create_schema(spark, "shop", str(tmp_path_factory.mktemp("shop")))
    tables.create_schema(spark, "shop")
    return "shop"


@pytest.mark.parametrize("kind", ["table", "path"])
def test_bring_to_scale(spark, schema_name, tmp_path, kind):
    target = f"{schema_name}.scaled" if kind == "table" else str(tmp_path / "scaled")

    def grow(n):
        return G.bring_to_scale(spark, target, 2 * n, n, lambda: fixture_plan(spark, n, 2, 16, ["A"]))

    assert [grow(n) for n in (10, 10, 30)] == ["rebuild", "reuse", "expand"]
    assert tables.read_any(spark, target).agg(F.count("*"), F.count_distinct("sku")).first()[:] == (60, 30)
    assert grow(20) == "rebuild"
    assert tables.read_any(spark, target).agg(F.count("*"), F.count_distinct("sku")).first()[:] == (40, 20)


def test_stored_or_built(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert tables.stored_or_built(spark, str(tmp_path / "m"), build).count() == 5
    assert len(calls) == 1


def test_telemetry_table_keeps_its_definition(spark, schema_name):
    name = f"{schema_name}.telemetry"
    plan = fixture_plan(spark, 5, 2, 16, ["A", "B"])
    registration.write_telemetry(plan, name)
    tables.set_property(spark, name, "space_id", "it's 7")
    registration.write_telemetry(plan.where("model_name = 'A'"), name)
    stored = spark.read.table(name)
    assert stored.count() == 10
    assert tables.get_property(spark, name, "space_id") == "it's 7"
    assert tables.get_property(spark, name, "nothing") is None and tables.get_property(spark, "shop.none", "x") is None
    # insertInto goes by position: the partition column comes last in the stored table.
    r = stored.where("region = 'REGION-01'").orderBy("sku").first()
    assert (r["sku"], r["model_name"], r["rmse"], r["mape"], r["params"]) == ("SKU-000000", "A", 0.1, None, {"learning_rate": "0.01"})
    comments = {f.name: f.metadata.get("comment") for f in stored.schema}
    assert comments == {f.name: f.metadata["comment"] for f in schema.columns_of(schema.TELEMETRY)}
    detail = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    assert detail["Comment"] == registration.TELEMETRY_COMMENT
    assert not tables.ensure_table(spark, name, schema.DEMAND, ["region"])


def test_a_failed_replacement_keeps_the_rows(spark, schema_name):
    name = f"{schema_name}.kept"
    spark.sql(f"CREATE TABLE {name} (a BIGINT, b STRING) USING parquet")
    tables.replace_rows(spark.range(3).selectExpr("id AS a", "'x' AS b"), name)
    with pytest.raises(Exception, match="boom"):
        tables.replace_rows(spark.range(3).selectExpr("id AS a", "CAST(raise_error('boom') AS STRING) AS b"), name)
    assert spark.read.table(name).count() == 3


def test_scale_action_looks_at_rows_and_skus(spark):
    cases = [(1000, 10, 1000, 10), (1000, 10, 1000, 100), (1000, 10, 2000, 20), (1000, 10, 1500, 20), (0, 0, 5, 5)]
    df = spark.createDataFrame(cases, "r bigint, s bigint, er bigint, ts bigint")
    got = df.select(G.scale_action(*[F.col(c) for c in ("r", "s", "er", "ts")])).collect()
    assert [r[0] for r in got] == ["reuse", "rebuild", "expand", "rebuild", "rebuild"]


def test_registration(spark, schema_name, tmp_path):
    fixture_plan(spark, 30, 2, 64, ["A", "B"]).write.parquet(str(tmp_path / "plan"))
    plan = spark.read.parquet(str(tmp_path / "plan"))
    done = registration.register(plan, f"{schema_name}.registered", str(tmp_path / "bundle"), n_endpoints=2)
    assert registration.stored_buckets(spark, done.telemetry_table) == done.buckets == 64
    assert registration.stored_models(spark, done.telemetry_table).count() == 120
    tags = {r["run_name"]: r["tags"] for r in done.endpoints.collect()}
    assert set(tags) == {f"REGION-0{r}_endpoint_0{i}" for r in (0, 1) for i in (0, 1)}
    uri = tags["REGION-01_endpoint_00"]["model_bundle_uri"]
    assert uri.startswith(done.bundle_root + "/") and spark.read.parquet(uri).count() == 60
    outcome = done.outcome
    tables.append_outcome(outcome, str(tmp_path / "outcomes"))
    tables.append_outcome(outcome, str(tmp_path / "outcomes"))
    got = spark.read.parquet(str(tmp_path / "outcomes")).select(F.from_json("payload", outcome.schema).alias("o")).select("o.*").collect()
    assert len(got) == 2 and got[0]["total_runs"] == 4 and got[0]["total_artifacts"] == 2 and got[0]["errors"] == 0


def test_write_and_read_by_name_or_path(spark, schema_name, tmp_path):
    assert tables.is_table_name("a.b.c") and not tables.is_table_name("/tmp/a.b") and not tables.is_table_name("plain")
    plan = fixture_plan(spark, 4, 2, 16, ["A"])
    for target in (f"{schema_name}.plan", str(tmp_path / "plan")):
        tables.persist_run_plan(plan, target)
        tables.persist_run_plan(plan, target)
        stored = tables.read_any(spark, target)
        keys = ["region", "sku", "model_name", "model_blob_bytes"]
        assert stored.schema.names == plan.schema.names and stored.count() == 8
        assert stored.select(*keys).exceptAll(plan.select(*keys)).count() == 0
