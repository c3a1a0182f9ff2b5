"""Queries over the model bundle: layout, index and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.operators import bundle, lookup, questions, shelf, train
from skuloom.plans.catalog import COEFS, TELEMETRY, near, query, r
from skuloom.plans.model_queries import SCORED, requests, scored_columns
from skuloom.plans.store import ModelStore

LAYOUT = f"""{COEFS},
buckets AS (SELECT least(512, greatest(64, count(DISTINCT sku_n) // 156)) AS n FROM coef),
days AS (SELECT region, sku_n, {', '.join(f'max(day_mean) FILTER (day_of_week = {d}) AS d{d}' for d in range(7))} FROM weekday GROUP BY region, sku_n),
placed AS (
  SELECT region, sku_n, printf('SKU-%06d', sku_n) AS sku, CAST(sku_n % n AS INTEGER) AS bucket, n_train, mean, intercept, slope,
         {', '.join(f'coalesce(d{d}, mean) AS d{d}' for d in range(7))}
  FROM coef LEFT JOIN days USING (region, sku_n) CROSS JOIN buckets),
names AS (SELECT unnest(['mean', 'price_ols', 'weekday_mean']) AS model_name)"""

# All that a stored model holds.
CONTENTS = f"""model_name, {r('mean')} AS mean, CASE WHEN model_name = 'price_ols' THEN {r('intercept', 3)} END AS intercept,
    CASE WHEN model_name = 'price_ols' THEN {r('slope')} END AS slope, CAST(n_train AS VARCHAR) AS n_train,
    {', '.join(f"CASE WHEN model_name = 'weekday_mean' THEN {r(f'd{d}')} END AS d{d}" for d in range(7))}"""


def contents(models: DataFrame, *keys: str) -> DataFrame:
    """Every coefficient out of the stored bytes, and a setting out of the params."""
    m = F.col("__m")
    return models.withColumn("__m", train.decoded(F.col("model_blob_bytes"))).select(
        *keys,
        "model_name",
        near(m["mean"], 6).alias("mean"),
        near(m["intercept"], 3).alias("intercept"),
        near(m["slope"], 6).alias("slope"),
        F.col("params")["n_train"].alias("n_train"),
        *[near(F.get(m["weekday"], F.lit(d)), 6).alias(f"d{d}") for d in range(7)],
    )


@query(
    "bundle_rows",
    f"""WITH {LAYOUT}
    SELECT region, bucket, sku, sku_n, {CONTENTS} FROM placed CROSS JOIN names""",
)
def bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bundle read back, region and bucket from its directory names, models decoded."""
    return contents(ModelStore(spark, sf_dir).bundle(), "region", "bucket", "sku", "sku_n")


@query(
    "bundle_audit",
    f"""WITH {LAYOUT}
    SELECT region, bucket, 3 * count(*) AS plan_rows, 3 * count(*) AS bundle_rows, count(*) AS plan_skus, count(*) AS bundle_skus,
           true AS has_files, true AS complete FROM placed GROUP BY region, bucket""",
)
def bundle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ModelStore(spark, sf_dir)
    found = bundle.audit(spark, store.bundle_root(), store.plan(), store.buckets())
    return found.select(
        "region", "bucket", "plan_rows", "bundle_rows", "plan_skus", "bundle_skus", (F.col("files") > 0).alias("has_files"), "complete"
    )


@query(
    "bundle_file_ranges",
    f"WITH {LAYOUT} SELECT region, bucket, 3 * count(*) AS n_rows, CAST(0 AS BIGINT) AS overlaps FROM placed GROUP BY region, bucket",
)
def bundle_file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per bucket over its files, and neighbouring files with overlapping sku ranges (none)."""
    ranges = bundle.file_ranges(spark, ModelStore(spark, sf_dir).bundle_root())
    return bundle.overlaps(ranges).select("region", "bucket", "n_rows", "overlaps")


@query(
    "bundle_lookup",
    f"""WITH {LAYOUT},
    asked AS (SELECT DISTINCT region, sku_n FROM demand WHERE holdout)
    SELECT p.region, p.bucket, p.sku, {CONTENTS} FROM asked a JOIN placed p ON a.region = p.region AND a.sku_n = p.sku_n
    CROSS JOIN names""",
)
def bundle_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of all requested skus: one join of the distinct keys with the bundle."""
    store = ModelStore(spark, sf_dir)
    # Of the maps, the join moves the one entry that is read.
    setting = F.create_map(F.lit("n_train"), F.col("params")["n_train"]).alias("params")
    models = store.bundle().select("region", "bucket", "sku", "sku_n", "model_name", "model_blob_bytes", setting)
    return contents(lookup.lookup_many(models, requests(spark, sf_dir), store.buckets()), "region", "bucket", "sku")


@query("score_from_bundle", f"WITH {TELEMETRY} {SCORED}")
def score_from_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out row predicted straight from the bundle, without a serving table."""
    store = ModelStore(spark, sf_dir)
    return scored_columns(lookup.score_from_bundle(requests(spark, sf_dir), store.bundle(), store.buckets()))


@query(
    "bundle_point_lookup",
    f"""WITH {LAYOUT},
    target AS (SELECT max(sku_n) AS sku_n FROM placed WHERE region = 'ASIA')
    SELECT region, bucket, sku, {CONTENTS} FROM placed JOIN target USING (sku_n) CROSS JOIN names WHERE region = 'ASIA'""",
)
def bundle_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models of one sku (the largest id in ASIA) by bucket pruning and row-group skipping."""
    store = ModelStore(spark, sf_dir)
    sku = store.bundle().where(F.col("region") == "ASIA").orderBy(F.desc("sku_n")).select("sku").first()[0]
    return contents(lookup.lookup_one(store.bundle(), "ASIA", sku, store.buckets()), "region", "bucket", "sku")


@query(
    "default_model_lookup",
    f"""WITH {LAYOUT.replace(COEFS, TELEMETRY)}
    SELECT s.region, s.sku, {CONTENTS.replace('model_name', 's.model_name').replace('AS s.model_name', 'AS model_name')}
    FROM served s JOIN placed p ON s.region = p.region AND s.sku = p.sku""",
)
def default_model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one model per (region, sku), whatever the number stored: the batch form of a point lookup."""
    store = ModelStore(spark, sf_dir)
    chosen = questions.default_models(store.telemetry())
    return contents(store.bundle().join(chosen, ["region", "sku", "model_name"]), "region", "sku")


@query(
    "lookup_sample",
    f"""WITH {COEFS},
    skus AS (SELECT DISTINCT printf('SKU-%06d', sku_n) AS sku FROM coef WHERE region = 'ASIA'),
    cold AS (SELECT sku FROM skus ORDER BY md5(sku || '/42'), sku LIMIT 100),
    warm AS (SELECT sku FROM skus ORDER BY md5(sku || '/43'), sku LIMIT 10)
    SELECT 'cold' AS path, sku, CAST(0 AS INTEGER) AS round FROM cold
    UNION ALL SELECT 'warm', sku, CAST(unnest(range(10)) AS INTEGER) FROM warm""",
)
def lookup_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = ModelStore(spark, sf_dir).plan()
    return lookup.lookup_sample(plan.where(F.col("region") == "ASIA").select("sku"))


@query(
    "shelf_lookup",
    f"""WITH {TELEMETRY},
    days AS (SELECT region, sku_n, {', '.join(f'max(day_mean) FILTER (day_of_week = {d}) AS d{d}' for d in range(7))} FROM weekday GROUP BY region, sku_n),
    asked AS (SELECT DISTINCT region, sku_n FROM demand WHERE holdout)
    SELECT region, sku, model_name, {r('t.mean')} AS mean, CASE WHEN model_name = 'price_ols' THEN {r('intercept', 3)} END AS intercept,
      CASE WHEN model_name = 'price_ols' THEN {r('slope')} END AS slope,
      {', '.join(f"CASE WHEN model_name = 'weekday_mean' THEN {r(f'coalesce(d{d}, t.mean)')} END AS d{d}" for d in range(7))}
    FROM telemetry t JOIN asked USING (region, sku_n) LEFT JOIN days USING (region, sku_n)""",
)
def shelf_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of all requested skus from the bucketed table, whose rows stay in their buckets."""
    found = shelf.lookup(spark, ModelStore(spark, sf_dir).shelf(), requests(spark, sf_dir))
    return contents(found.withColumn("params", F.create_map().cast("map<string,string>")), "region", "sku").drop("n_train")


@query("shelf_scores", f"WITH {TELEMETRY} {SCORED}")
def shelf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out row predicted from the bucketed table: the model is chosen from narrow columns before a blob is read."""
    return scored_columns(shelf.score(spark, ModelStore(spark, sf_dir).shelf(), requests(spark, sf_dir)))
