"""Latency statistics over timing samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.functions.ranks import batch_numbers, join_groups, nearest_rank, order_statistics

BATCH = 100


def cold_and_warm(samples: DataFrame, key: str, seq: str) -> DataFrame:
    """Add ``path``: cold for the first sample of a key, warm afterwards.

    The first sample is found by a pre-aggregated minimum, and joined back on the unique ``seq``.
    """
    first = samples.groupBy(key).agg(F.min(seq).alias(seq)).select(seq, F.lit("cold").alias("__path"))
    return samples.join(first, seq, "left").withColumn("path", F.coalesce("__path", F.lit("warm"))).drop("__path")


def path_stats(samples: DataFrame, groups: list[str], ms: str) -> DataFrame:
    """n, mean, median and nearest-rank p95 per group."""
    ranks = order_statistics(
        samples, groups, ms,
        {
            "__lo": (0.5, lambda n: F.floor((n - 1) / 2)),
            "__hi": (0.5, lambda n: F.floor(n / 2)),
            "p95_ms": (0.95, nearest_rank(0.95)),
        },
    ).withColumn("p50_ms", (F.col("__lo") + F.col("__hi")) / 2)
    means = samples.where(F.col(ms).isNotNull()).groupBy(*groups).agg(F.avg(ms).alias("mean_ms"))
    return join_groups(ranks, means, groups).select(*groups, "n", "mean_ms", "p50_ms", "p95_ms")


def stacked(results: list[DataFrame], unmeasured: DataFrame | None = None) -> DataFrame:
    """Results of several approaches below each other, rounded; approaches never measured keep an empty row."""
    columns = ["approach", "path", "phase", "n", "mean_ms", "p50_ms", "p95_ms"]
    if unmeasured is not None:
        empty = {"path": "string", "phase": "string", "n": "bigint", "mean_ms": "double", "p50_ms": "double", "p95_ms": "double"}
        results = [*results, unmeasured.select("approach", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])]
    out = results[0].select(*columns)
    for r in results[1:]:
        out = out.unionByName(r.select(*columns))
    return out.select(*columns[:4], *[F.round(c, 3).alias(c) for c in columns[4:]])


def _rank_in(values: Column, q: float) -> Column:
    n = F.size(values)
    return F.get(values, F.least(n - 1, F.floor(F.lit(q) * n).cast("int")))


def batch_stats(samples: DataFrame, group: list[str], seq: str, ms: list[str], batch: int = BATCH) -> DataFrame:
    """p50 and p95 of every full batch of consecutive samples; a last part of a batch is not reported.

    A batch is ``batch`` rows, so sorting its values in an array is bounded.
    """
    numbered = batch_numbers(samples, group, seq, batch)
    lists = numbered.groupBy(*group, "batch_no").agg(
        F.count("*").alias("n"), *[F.sort_array(F.collect_list(c)).alias(c) for c in ms]
    )
    return lists.where(F.col("n") == batch).select(
        *group,
        (F.col("batch_no") * batch + 1).alias("first_n"),
        ((F.col("batch_no") + 1) * batch).alias("last_n"),
        *[_rank_in(F.col(c), q).alias(f"{c}_p{round(q * 100)}") for c in ms for q in (0.50, 0.95)],
    )


def final_summary(samples: DataFrame, group: list[str], ms: list[str]) -> DataFrame:
    """Mean and p95 per phase and the mean of the phases' total; groups without samples give no row.

    The phases are ranked together as rows of one long table: one sketch and one count for all of them.
    """
    means = samples.groupBy(*group).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in ms])
    totalled = means.withColumn("total_mean", sum((F.col(f"{c}_mean") for c in ms[1:]), F.col(f"{ms[0]}_mean")))
    phases = F.array(*[F.struct(F.lit(c).alias("__phase"), F.col(c).cast("double").alias("__ms")) for c in ms])
    long = samples.select(*group, F.inline(phases))
    ranks = order_statistics(long, [*group, "__phase"], "__ms", {"p95": (0.95, nearest_rank(0.95))})
    wide = ranks.groupBy(*group).agg(*[F.max(F.when(F.col("__phase") == c, F.col("p95"))).alias(f"{c}_p95") for c in ms])
    return join_groups(totalled, wide, group)
