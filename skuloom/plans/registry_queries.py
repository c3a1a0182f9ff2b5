"""Queries over the run hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.functions import skus as S
from skuloom.functions.ranks import sequence_numbers
from skuloom.operators import latency, publish, registry, routing, run_log
from skuloom.plans.catalog import COEFS, DEMAND, TELEMETRY, near, query, r, run_id
from skuloom.plans.store import ModelStore
from skuloom.session import fresh_path
from skuloom.sources import demand as D
from skuloom.sources import tables

REGION_ID = run_id("'region'", "region")
SKU_ID = run_id("'sku'", "region", "sku")
MODEL_ID = run_id("'model'", "region", "sku", "model_name")

KEYS = f"""{COEFS},
keys AS (SELECT region, sku_n, printf('SKU-%06d', sku_n) AS sku FROM coef),
plan AS (SELECT region, sku, model_name FROM keys CROSS JOIN (SELECT unnest(['mean', 'price_ols', 'weekday_mean']) AS model_name))"""

REGION_RUNS = f"""SELECT DISTINCT {REGION_ID} AS run_id, CAST(NULL AS VARCHAR) AS parent_id, 'region' AS layer,
    'region_' || region AS run_name, 'Demand_Forecasting-' || region AS experiment FROM keys"""
SKU_RUNS = f"""SELECT {SKU_ID} AS run_id, {REGION_ID} AS parent_id, 'sku' AS layer, 'sku_' || sku AS run_name,
    'Demand_Forecasting-' || region AS experiment FROM keys"""
MODEL_RUNS = f"""SELECT {MODEL_ID} AS run_id, {SKU_ID} AS parent_id, 'model' AS layer, sku || '_' || model_name AS run_name,
    'Demand_Forecasting-' || region AS experiment FROM plan"""


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ModelStore(spark, sf_dir).plan()


@query("collapsed_runs", f"WITH {KEYS} {REGION_RUNS} UNION ALL {SKU_RUNS}")
def collapsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.collapsed_runs(plan(spark, sf_dir)).drop("tags")


def tag_rows(source: str, run: str, **tags: str) -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT {run} AS run_id, '{k}' AS key, {v} AS value FROM {source}" for k, v in tags.items())


@query(
    "collapsed_tags",
    f"""WITH {KEYS} {tag_rows('keys', REGION_ID, layer="'region'", region='region')}
    UNION ALL {tag_rows('keys', SKU_ID, layer="'sku'", region='region', sku='sku', model_count="'3'")}""",
)
def collapsed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.tags_long(registry.collapsed_runs(plan(spark, sf_dir)))


@query("nested_runs", f"WITH {KEYS} {REGION_RUNS} UNION ALL {SKU_RUNS} UNION ALL {MODEL_RUNS}")
def nested_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.nested_runs(plan(spark, sf_dir)).drop("tags")


@query(
    "nested_tags",
    f"""WITH {KEYS} {tag_rows('keys', REGION_ID, layer="'region'", region='region')}
    UNION ALL {tag_rows('keys', SKU_ID, layer="'sku'", region='region', sku='sku')}
    UNION ALL {tag_rows('plan', MODEL_ID, layer="'model'", region='region', sku='sku', model_name='model_name')}""",
)
def nested_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.tags_long(registry.nested_runs(plan(spark, sf_dir)))


METRIC_ROWS = " UNION ALL ".join(
    f"SELECT region, sku, model_name, '{m}' AS k, {r(m, 4)} AS v FROM telemetry WHERE {m} IS NOT NULL"
    for m in ("rmse", "mape", "r2", "mae", "mse", "accuracy", "precision", "recall", "f1")
)


def checked_metrics(df: DataFrame) -> DataFrame:
    return df.select("run_id", "key", near("value", 4).alias("value"), "step")


@query(
    "collapsed_metrics",
    f"""WITH {TELEMETRY}, entries AS ({METRIC_ROWS})
    SELECT {SKU_ID} AS run_id, model_name || '.' || k AS key, v AS value, CAST(0 AS BIGINT) AS step FROM entries""",
)
def collapsed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_metrics(registry.run_metrics(plan(spark, sf_dir), collapsed=True))


@query(
    "nested_metrics",
    f"""WITH {TELEMETRY}, entries AS ({METRIC_ROWS})
    SELECT {MODEL_ID} AS run_id, k AS key, v AS value, CAST(0 AS BIGINT) AS step FROM entries""",
)
def nested_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_metrics(registry.run_metrics(plan(spark, sf_dir), collapsed=False))


PARAM_ROWS = """SELECT region, sku, model_name, unnest(['model_type', 'target_metric', 'n_train', 'n_holdout', 'features_count']) AS k,
    unnest([model_name, 'demand', CAST(n_train AS VARCHAR), CAST(n_holdout AS VARCHAR),
            CASE WHEN model_name = 'mean' THEN '0' ELSE '1' END]) AS v FROM telemetry"""
COEF_ROWS = f"""SELECT region, sku, model_name, unnest(['slope', 'intercept']) AS k,
    unnest([{r('slope')}, {r('intercept', 3)}]) AS v FROM telemetry WHERE model_name = 'price_ols'"""


def checked_params(df: DataFrame) -> DataFrame:
    """Coefficients, which are numbers written as text, are compared as numbers."""
    name, number = F.substring_index("key", ".", -1), F.col("value").try_cast("double")
    return df.select(
        "run_id",
        "key",
        F.when(~name.isin("slope", "intercept"), F.col("value")).alias("value"),
        F.when(name == "slope", near(number, 6)).when(name == "intercept", near(number, 3)).alias("number"),
    )


@query(
    "collapsed_params",
    f"""WITH {TELEMETRY}, texts AS ({PARAM_ROWS}), numbers AS ({COEF_ROWS})
    SELECT {SKU_ID} AS run_id, model_name || '.' || k AS key, v AS value, CAST(NULL AS DOUBLE) AS number FROM texts
    UNION ALL SELECT {SKU_ID}, model_name || '.' || k, NULL, v FROM numbers""",
)
def collapsed_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_params(registry.run_params(plan(spark, sf_dir), collapsed=True))


@query(
    "nested_params",
    f"""WITH {TELEMETRY}, texts AS ({PARAM_ROWS}), numbers AS ({COEF_ROWS})
    SELECT {MODEL_ID} AS run_id, k AS key, v AS value, CAST(NULL AS DOUBLE) AS number FROM texts
    UNION ALL SELECT {MODEL_ID}, k, NULL, v FROM numbers""",
)
def nested_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_params(registry.run_params(plan(spark, sf_dir), collapsed=False))


@query(
    "prefixed_param_keys",
    f"""WITH {KEYS}, names AS (SELECT unnest(['model_type', 'target_metric', 'n_train', 'n_holdout', 'features_count']) AS k)
    SELECT model_name || '.' || k AS key, count(*) AS models FROM plan CROSS JOIN names GROUP BY 1
    UNION ALL SELECT 'price_ols.' || unnest(['slope', 'intercept']) AS key, count(*) FROM plan WHERE model_name = 'price_ols'""",
)
def prefixed_param_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = plan(spark, sf_dir).select(
        F.explode(F.map_keys(registry.prefixed(F.col("params"), F.col("model_name")))).alias("key")
    )
    return keys.groupBy("key").agg(F.count("*").alias("models"))


@query(
    "region_summaries",
    f"""WITH {KEYS}
    SELECT {REGION_ID} AS run_id, region, CAST(count(*) AS DOUBLE) AS model_count, 'models/region=' || region AS bundle_uri
    FROM plan GROUP BY region""",
)
def region_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.region_summaries(plan(spark, sf_dir), "models")


ENDPOINTS = f"""{KEYS},
endpoints AS (SELECT region, unnest(range(3)) AS i FROM (SELECT DISTINCT region FROM keys))"""
ENDPOINT_ID = run_id("'deployable_endpoint'", "region", "CAST(i AS VARCHAR)")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.endpoint_runs(plan(spark, sf_dir).select("region").distinct(), 3, "demo.telemetry", "models")


@query(
    "endpoint_runs",
    f"""WITH {ENDPOINTS}
    SELECT {ENDPOINT_ID} AS run_id, CAST(NULL AS VARCHAR) AS parent_id, 'deployable_endpoint' AS layer,
           printf('%s_endpoint_%02d', region, i) AS run_name,
           printf('Demand_Forecasting-%s_endpoint_%02d', region, i) AS experiment FROM endpoints""",
)
def endpoint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints(spark, sf_dir).drop("tags")


@query(
    "endpoint_tags",
    f"""WITH {ENDPOINTS} """ + tag_rows(
        "endpoints", ENDPOINT_ID, layer="'deployable_endpoint'", region="region", endpoint_index="CAST(i AS VARCHAR)",
        demand_forecasting_table="'demo.telemetry'", model_bundle_uri="'models/region=' || region", space_id="''", space_name="''",
    ),
)
def endpoint_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.tags_long(endpoints(spark, sf_dir))


# CRC-32 (polynomial 0xEDB88320) spelled out, since the checking engine has no such function.
CRC32 = """
crc_table AS (
  WITH RECURSIVE t(n, c, k) AS (
    SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
    UNION ALL
    SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8
  ) SELECT n, c FROM t WHERE k = 8
),
crc_skus AS (
  WITH RECURSIVE s(sku, c, i) AS (
    SELECT sku, CAST(4294967295 AS BIGINT), 1 FROM (SELECT DISTINCT sku FROM keys)
    UNION ALL
    SELECT sku, xor(t.c, s.c >> 8), i + 1
    FROM s JOIN crc_table t ON t.n = xor(s.c, CAST(ascii(substr(sku, i, 1)) AS BIGINT)) & 255
    WHERE i <= length(sku)
  ) SELECT sku, xor(c, 4294967295) AS crc FROM s WHERE i = length(sku) + 1
)"""


@query(
    "endpoint_routes",
    f"""WITH {KEYS}, {CRC32}
    SELECT region, sku, CAST(crc % 3 AS INTEGER) AS endpoint_index, printf('%s_endpoint_%02d', region, crc % 3) AS endpoint
    FROM keys JOIN crc_skus USING (sku)""",
)
def endpoint_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.routes(plan(spark, sf_dir).select("region", "sku").distinct(), 3)


@query(
    "sharded_sku_runs",
    f"""WITH {KEYS}, {CRC32}
    SELECT {SKU_ID} AS run_id, printf('Demand_Forecasting-%s/shard_%02d', region, crc % 4) AS experiment
    FROM keys JOIN crc_skus USING (sku)""",
)
def sharded_sku_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sku_runs(plan(spark, sf_dir), n_shards=4).select("run_id", "experiment")


@query(
    "shard_balance",
    f"""WITH {KEYS}, {CRC32}
    SELECT printf('Demand_Forecasting-%s/shard_%02d', region, crc % 4) AS experiment, count(*) AS sku_runs
    FROM keys JOIN crc_skus USING (sku) GROUP BY 1""",
)
def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = plan(spark, sf_dir)
    shards = registry.shard_experiments(models.select("region").distinct(), 4)
    filled = registry.sku_runs(models, n_shards=4).groupBy("experiment").agg(F.count("*").alias("n"))
    return shards.join(filled, "experiment", "left").select("experiment", F.coalesce("n", F.lit(0)).alias("sku_runs"))


@query(
    "runs_to_create",
    f"""WITH {DEMAND},
    wanted AS (SELECT DISTINCT region, sku FROM demand),
    trained AS (SELECT DISTINCT region, sku FROM demand WHERE NOT holdout)
    SELECT {SKU_ID} AS run_id, region, sku FROM wanted ANTI JOIN trained USING (region, sku)""",
)
def runs_to_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find-or-create: sku runs wanted for all demand keys that the registered plan does not have yet."""
    store = ModelStore(spark, sf_dir)
    wanted = store.profile().select("region", S.sku_id(F.col("sku_n")).alias("sku")).withColumn(
        "run_id", S.run_id("sku", F.col("region"), F.col("sku"))
    )
    return registry.not_registered(wanted, registry.sku_runs(store.plan()))


@query(
    "run_status_counts",
    f"""WITH {TELEMETRY}
    SELECT region, count(*) AS runs, count(rmse) AS finished, count(*) - count(rmse) AS failed FROM telemetry GROUP BY region""",
)
def run_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.status_counts(registry.run_status(plan(spark, sf_dir)))


@query(
    "first_errors",
    f"""WITH {TELEMETRY}
    SELECT region, sku, model_name, region || ': no holdout rows for ' || sku AS error FROM telemetry WHERE rmse IS NULL
    ORDER BY region, sku, model_name LIMIT 5""",
)
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.first_errors(registry.run_status(plan(spark, sf_dir)))


@query(
    "run_totals",
    f"""WITH {KEYS}
    SELECT (SELECT count(*) FROM keys) + (SELECT count(*) FROM plan) AS total_runs,
           (SELECT count(DISTINCT region) FROM keys) AS total_artifacts""",
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.totals(registry.nested_runs(plan(spark, sf_dir)))


@query(
    "registration_outcome",
    f"""WITH {TELEMETRY}
    SELECT 'nested' AS strategy, count(DISTINCT region || sku) + count(*) AS total_runs, count(DISTINCT region) AS total_artifacts,
           (count(DISTINCT region || sku) + count(*)) / CAST(8.0 AS DOUBLE) AS throughput_runs_per_sec, CAST(8.0 AS DOUBLE) AS elapsed_seconds,
           CAST(0.0 AS DOUBLE) AS throughput_at_zero, count(*) - count(rmse) AS errors FROM telemetry""",
)
def registration_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = plan(spark, sf_dir)
    summary = registry.outcome(registry.nested_runs(models), registry.run_status(models), "nested", 8.0)
    return summary.withColumn("throughput_at_zero", S.throughput(F.col("total_runs"), F.lit(0.0)))


@query(
    "stored_outcome",
    f"""WITH {TELEMETRY},
    errors AS (SELECT region || ': no holdout rows for ' || sku AS error FROM telemetry WHERE rmse IS NULL ORDER BY region, sku, model_name LIMIT 5),
    timed AS (SELECT event_type AS path, median(value) AS p50,
      list_sort(list(value))[CAST(least(count(value) - 1, floor(0.95 * count(value))) AS BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type)
    SELECT 'nested' AS strategy, (SELECT count(*) - count(rmse) FROM telemetry) AS errors,
           (SELECT array_to_string(list_sort(list(error)), ';') FROM errors) AS error_list, path, {r('p50')} AS p50, {r('p95')} AS p95 FROM timed""",
)
def stored_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registration's outcome with its first errors and lookup times, appended as JSON and read back."""
    models = plan(spark, sf_dir)
    status = registry.run_status(models)
    summary = registry.outcome(registry.nested_runs(models), status, "nested", 8.0)
    timed = latency.path_stats(D.table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("value").alias("ms")), ["path"], "ms")
    full = registry.outcome_payload(summary, registry.first_errors(status), timed.select("path", F.col("p50_ms").alias("p50"), F.col("p95_ms").alias("p95")))
    target = fresh_path(spark, "outcomes")
    tables.append_outcome(full, target)
    read = spark.read.parquet(target).select(F.from_json("payload", full.schema).alias("o")).select("o.*")
    rows = read.select("strategy", "errors", F.array_join("error_list", ";").alias("error_list"), F.explode("lookup_ms").alias("path", "t"))
    return rows.select("strategy", "errors", "error_list", "path", near("t.p50").alias("p50"), near("t.p95").alias("p95"))


@query(
    "region_records",
    f"""WITH {COEFS}
    SELECT printf('SKU-%06d', sku_n) AS sku, model_name, row_number() OVER (ORDER BY sku_n, model_name) AS position
    FROM coef CROSS JOIN (SELECT unnest(['mean', 'price_ols', 'weekday_mean']) AS model_name) WHERE region = 'ASIA'""",
)
def region_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region's records in the order in which a consumer gets them."""
    return registry.region_records(plan(spark, sf_dir), "ASIA").select("sku", "model_name", "position")


@query(
    "registered_against_expected",
    f"""WITH {KEYS},
    expected AS (
      SELECT region, 'region' AS layer, 1 AS n FROM keys GROUP BY region
      UNION ALL SELECT region, 'sku', count(DISTINCT sku_n) FROM demand GROUP BY region
      UNION ALL SELECT region, 'model', 3 * count(DISTINCT sku_n) FROM demand GROUP BY region),
    found AS (
      SELECT region, 'region' AS layer, 1 AS n FROM keys GROUP BY region
      UNION ALL SELECT region, 'sku', count(*) FROM keys GROUP BY region
      UNION ALL SELECT region, 'model', count(*) FROM plan GROUP BY region)
    SELECT region, layer, e.n AS expected_runs, f.n AS registered_runs, e.n = f.n AS complete
    FROM expected e JOIN found f USING (region, layer)""",
)
def registered_against_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs registered per layer against what all demand keys would give: keys without training rows are missing."""
    store = ModelStore(spark, sf_dir)
    per_region = store.profile().groupBy("region").agg(F.count("*").alias("skus"))
    layers = F.array(
        F.struct(F.lit("region").alias("layer"), F.lit(1).cast("bigint").alias("expected_runs")),
        F.struct(F.lit("sku").alias("layer"), F.col("skus").alias("expected_runs")),
        F.struct(F.lit("model").alias("layer"), (F.col("skus") * 3).alias("expected_runs")),
    )
    expected = per_region.select("region", F.inline(layers))
    return registry.registered_against_expected(registry.nested_runs(store.plan()), expected)


@query(
    "duplicate_keys",
    f"""WITH {DEMAND}
    SELECT region, sku, CAST(date AS VARCHAR) AS model_name, count(*) AS copies FROM demand
    GROUP BY region, sku, date HAVING count(*) > 1""",
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once; asked here of (region, sku, day), which is not a key."""
    days = D.demand(spark, sf_dir, inventory=False).withColumn("model_name", F.col("date").cast("string"))
    return registry.duplicate_keys(days)


@query(
    "progress_marks",
    f"""WITH {KEYS},
    numbered AS (SELECT region, sku, model_name, row_number() OVER (PARTITION BY region ORDER BY sku, model_name) AS rn FROM plan)
    SELECT region, sku, model_name, rn FROM numbered WHERE rn % 1000 = 0""",
)
def progress_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thousandth record of each region's (sku, model) order, numbered slice by slice of skus."""
    numbered = sequence_numbers(
        plan(spark, sf_dir).select("region", "sku", "model_name", S.sku_number("sku").alias("sku_n")),
        ["region"], F.floor(F.col("sku_n") / 1000), ["sku_n", "model_name"],
    )
    return registry.progress_marks(numbered, 1000).select("region", "sku", "model_name", F.col("rn").cast("bigint").alias("rn"))


@query(
    "registration_errors",
    f"""WITH {KEYS},
    sizes AS (SELECT region, count(DISTINCT sku_n) AS skus, count(*) FILTER (sku_n % 7 = 0) AS sevens, count(*) FILTER (sku_n % 2 = 1) AS odd FROM keys GROUP BY region)
    SELECT region, 3 * CASE WHEN region IN ('ASIA', 'EUROPE') THEN skus ELSE odd END AS models,
      CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'check' END AS stage,
      CASE region WHEN 'ASIA' THEN CAST(3 * sevens AS VARCHAR) || ' keys that occur more than once'
        WHEN 'EUROPE' THEN CAST(3 * sevens AS VARCHAR) || ' rows without a model' END AS error
    FROM sizes""",
)
def registration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second publication in which two regions are unfit: they keep all their models, the others hold their odd skus."""
    store, root = ModelStore(spark, sf_dir), fresh_path(spark, "published")
    models, seventh = store.plan().drop("blob_bytes"), S.sku_number("sku") % 7 == 0
    publish.publish(models, root, store.buckets())
    blob = F.when((F.col("region") == "EUROPE") & seventh, F.lit(None)).otherwise(F.col("model_blob_bytes"))
    twice = models.where((F.col("region") == "ASIA") & seventh)
    odd = (S.sku_number("sku") % 2 == 1) | F.col("region").isin("ASIA", "EUROPE")
    done = publish.publish(models.where(odd).withColumn("model_blob_bytes", blob).unionByName(twice), root, store.buckets())
    held = publish.models(spark, root).groupBy("region").agg(F.count("*").alias("models"))
    return held.join(done.errors, "region", "left").select("region", "models", "stage", "error")


@query(
    "run_status_history",
    f"""WITH {TELEMETRY}
    SELECT {MODEL_ID} AS run_id, region, CASE WHEN sku_n % 5 = 0 THEN 'FAILED' WHEN rmse IS NULL THEN 'FAILED' ELSE 'FINISHED' END AS status,
      CASE WHEN sku_n % 5 = 0 THEN 'terminated' WHEN rmse IS NULL THEN region || ': no holdout rows for ' || sku END AS error,
      CAST(2 AS BIGINT) AS events FROM telemetry""",
)
def run_status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run starts and ends, but each fifth sku's are terminated; ends are appended first, starts late and twice, and folded between."""
    log = fresh_path(spark, "run_log")
    ended = registry.run_status(plan(spark, sf_dir))
    fifth = S.sku_number("sku") % 5 == 0
    when = {k: F.lit(f"2024-01-01 00:0{k}:00") for k in range(3)}
    begun = ended.withColumns({"status": F.lit(run_log.RUNNING), "error": F.lit(None).cast("string")})
    run_log.append(run_log.status_events(ended.where(~fifth), when[1], F.lit(1)), log)
    run_log.compact(spark, log)
    for _ in range(2):
        run_log.append(run_log.status_events(begun, when[0], F.lit(0)), log)
    run_log.compact(spark, log)
    run_log.append(run_log.terminated(run_log.current(spark, log), when[2], F.lit(2)), log)
    counts = run_log.history(spark, log).groupBy("run_id").agg(F.count("*").alias("events"))
    return run_log.current(spark, log).join(counts, "run_id").select("run_id", "region", "status", "error", "events")


def owners(key: str, given: dict[str, float]) -> str:
    """SQL of :func:`skuloom.operators.routing.owner_of`: the least weighted draw."""
    rows = ", ".join(f"('{o}', CAST({w} AS DOUBLE))" for o, w in given.items())
    draw = f"(CAST('0x' || substr(md5({key} || '/' || owner), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)"
    return f"(SELECT arg_min(owner, -ln({draw}) / weight) FROM (VALUES {rows}) AS o(owner, weight))"


BEFORE = {"00": 1.0, "01": 2.0, "02": 1.0}
AFTER = {**BEFORE, "03": 2.0}


@query(
    "routes_after_growth",
    f"""WITH {KEYS}
    SELECT region, sku, region || '_endpoint_' || {owners("region || '/' || sku", BEFORE)} AS was,
      region || '_endpoint_' || {owners("region || '/' || sku", AFTER)} AS now FROM keys""",
)
def routes_after_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint of every key before and after one of double weight joins: what moves goes there."""
    keys = plan(spark, sf_dir).select("region", "sku").distinct()
    old, new = (routing.routes(keys, list(e), list(e.values())).select("region", "sku", F.col("endpoint").alias(c)) for e, c in ((BEFORE, "was"), (AFTER, "now")))
    return old.join(new, ["region", "sku"])


@query(
    "shards_after_growth",
    f"""WITH {KEYS}, skus AS (SELECT DISTINCT sku FROM keys)
    SELECT sku, CAST({owners('sku', {f'{i:02d}': 1.0 for i in range(4)})} AS INTEGER) AS shard,
      CAST({owners('sku', {f'{i:02d}': 1.0 for i in range(5)})} AS INTEGER) AS grown_shard FROM skus""",
)
def shards_after_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-experiment of every sku with four and with five shards."""
    skus = plan(spark, sf_dir).select("sku").distinct()
    return skus.select("sku", *[routing.weighted_shard(F.col("sku"), n).alias(c) for n, c in ((4, "shard"), (5, "grown_shard"))])
