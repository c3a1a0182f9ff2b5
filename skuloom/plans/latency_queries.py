"""Latency statistics with the events table as the timing samples (value in ms, event type as the phase)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.functions.ranks import quantiles
from skuloom.operators import latency
from skuloom.plans.catalog import query, r, rounded
from skuloom.session import fresh_path, materialize
from skuloom.sources import demand as D

SAMPLES = """
samples AS (
  SELECT event_id, event_type AS phase, value AS ms,
         CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'cold' ELSE 'warm' END AS path
  FROM events
)"""


def nearest(values: str, q: str) -> str:
    return f"list_sort(list({values}))[CAST(least(count(*) - 1, floor(CAST({q} AS DOUBLE) * count(*))) AS BIGINT) + 1]"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    return latency.cold_and_warm(events, "user_id", "event_id")


STATS = f"count(*) AS n, {r('avg(ms)', 3)} AS mean_ms, {r('median(ms)', 3)} AS p50_ms, {r(nearest('ms', '0.95'), 3)} AS p95_ms"


@query(
    "latency_by_path",
    f"""WITH {SAMPLES}
    SELECT 'events' AS approach, path, phase, {STATS} FROM samples GROUP BY path, phase
    UNION ALL SELECT 'events', path, 'total', {STATS} FROM samples GROUP BY path
    UNION ALL SELECT DISTINCT 'unmeasured', NULL, NULL, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM events""",
)
def latency_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold and warm statistics per phase and in total, with an empty row for an approach never measured."""
    rows = materialize(samples(spark, sf_dir), fresh_path(spark, "samples"))
    by_phase = latency.path_stats(rows, ["path", "phase"], "ms").withColumn("approach", F.lit("events"))
    total = latency.path_stats(rows, ["path"], "ms").withColumn("approach", F.lit("events")).withColumn("phase", F.lit("total"))
    unmeasured = D.table(spark, sf_dir, "events").select(F.lit("unmeasured").alias("approach")).distinct()
    return latency.stacked([by_phase, total], unmeasured)


@query(
    "latency_batches",
    f"""WITH numbered AS (
      SELECT event_type AS phase, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
    batches AS (SELECT phase, (rn - 1) // 100 AS b, count(*) AS n, {nearest('ms', '0.5')} AS p50, {nearest('ms', '0.95')} AS p95
                FROM numbered GROUP BY phase, b)
    SELECT phase, b * 100 + 1 AS first_n, (b + 1) * 100 AS last_n, {r('p50')} AS ms_p50, {r('p95')} AS ms_p95
    FROM batches WHERE n = 100""",
)
def latency_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    return rounded(latency.batch_stats(rows, ["phase"], "event_id", ["ms"]))


@query(
    "latency_summary",
    f"""WITH timed AS (SELECT event_type AS region, value AS create_ms, value * 2 AS batch_ms, value / 4 AS terminate_ms FROM events)
    SELECT region, count(*) AS n, {r('avg(create_ms)')} AS create_ms_mean, {r('avg(batch_ms)')} AS batch_ms_mean,
           {r('avg(terminate_ms)')} AS terminate_ms_mean, {r('avg(create_ms) + avg(batch_ms) + avg(terminate_ms)')} AS total_mean,
           {r(nearest('create_ms', '0.95'))} AS create_ms_p95, {r(nearest('batch_ms', '0.95'))} AS batch_ms_p95,
           {r(nearest('terminate_ms', '0.95'))} AS terminate_ms_p95
    FROM timed GROUP BY region""",
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final summary of three phases per group; the phases are the event value, twice and a quarter of it."""
    value = F.col("value")
    timed = D.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("region"), value.alias("create_ms"), (value * 2).alias("batch_ms"), (value / 4).alias("terminate_ms")
    )
    return rounded(latency.final_summary(timed, ["region"], ["create_ms", "batch_ms", "terminate_ms"]))


@query(
    "latency_quantiles",
    f"""SELECT event_type AS phase, count(*) AS n, {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.9)')} AS p90,
           {r('quantile_cont(value, 0.99)')} AS p99 FROM events GROUP BY event_type""",
)
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), "value")
    return rounded(quantiles(rows, ["phase"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99}))
