"""Exact ranks and row numbers without putting a whole group into one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuloom.functions.skew import BROADCAST_ROWS, broadcast_if
from skuloom.session import checkpointed

SKETCH_ACCURACY = 10_000
SLICE_ROWS = 1_000_000
# Groups and zones known to be no larger than this are ranked by a plain window.
WINDOW_ROWS = 1_000_000
SUBZONES = 100


def join_groups(left: DataFrame, right: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on grouping columns in which NULL is a group like any other."""
    renamed = right.withColumnsRenamed({g: f"__g_{g}" for g in groups})
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups])
    return left.join(renamed, same, how).drop(*[f"__g_{g}" for g in groups])


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """0-based position min(n - 1, floor(q * n))."""
    return lambda n: F.least(n - 1, F.floor(F.lit(q) * n.cast("double")).cast("bigint"))


def order_statistics(
    df: DataFrame,
    groups: list[str],
    value: str,
    stats: dict[str, tuple[float, Callable[[Column], Column]]],
    window_rows: int | None = None,
) -> DataFrame:
    """Value at given sorted positions per group: one row per group with ``n`` and one column per stat.

    ``stats`` maps a name to (quantile the position is near, n -> 0-based position). A quantile sketch
    only proposes cut points around each wanted quantile; positions are then counted exactly, so a poor
    sketch costs balance and never the answer; zones that are still large are cut again. Only the few rows between the cut points around
    a wanted position are sorted, and equal values are counted together before they move. Where the counts show that all
    groups are small, a window ranks them. ``df`` is read up to three times: store it first when it is expensive.
    """
    margin = 2.0 / SKETCH_ACCURACY
    wanted = sorted({min(1.0, max(0.0, q + d)) for q, _ in stats.values() for d in (-margin, margin)})
    keys = [F.col(g) for g in groups]
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())

    sketch = checkpointed(
        rows.groupBy(*groups).agg(
            F.count("*").alias("n"),
            F.percentile_approx("__v", F.array(*[F.lit(q) for q in wanted]), F.lit(SKETCH_ACCURACY)).alias("__cuts"),
        )
    )
    groups_found, largest = sketch.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    # Everything broadcast below has at most one row per group and stat.
    hint = broadcast_if(groups_found * len(stats) <= BROADCAST_ROWS)
    positions = sketch.select(
        *groups,
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("__stat"), position(F.col("n")).cast("bigint").alias("__pos"))
                    for name, (_, position) in stats.items()
                ]
            )
        ),
    )
    if largest <= (window_rows or WINDOW_ROWS):
        place = F.row_number().over(W.partitionBy(*groups).orderBy("__v")) - 1
        ranked = rows.withColumn("__pos", place.cast("bigint"))
        return _one_row_per_group(join_groups(ranked, hint(positions), [*groups, "__pos"]), groups, stats)
    cuts = [F.get("__cuts", F.lit(i)) for i in range(len(wanted))]
    zone = sum((F.when(F.col("__v") >= c, F.lit(1)).otherwise(F.lit(0)) for c in cuts), F.lit(0))
    zoned = join_groups(rows, hint(sketch.drop("n")), groups).select(*groups, "__v", zone.alias("__zone"))

    # At most len(wanted) + 1 zones per group, so this window is tiny.
    before = W.partitionBy(*groups).orderBy("__zone").rowsBetween(W.unboundedPreceding, -1)
    zones = zoned.groupBy(*groups, "__zone").agg(F.count("*").alias("__c")).withColumn(
        "__start", F.coalesce(F.sum("__c").over(before), F.lit(0))
    )
    targets = checkpointed(
        join_groups(positions, zones, groups)
        .where((F.col("__pos") >= F.col("__start")) & (F.col("__pos") < F.col("__start") + F.col("__c")))
        .select(*groups, "n", "__stat", "__zone", (F.col("__pos") - F.col("__start")).alias("__pos"), "__c")
    )
    zoned, targets = _split_zones(zoned, targets, groups, max(window_rows or WINDOW_ROWS, 10 * SUBZONES))
    near = (
        join_groups(zoned, hint(targets.select(*groups, "__zone").distinct()), [*groups, "__zone"], "left_semi")
        .groupBy(*groups, "__zone", "__v")
        .agg(F.count("*").alias("__c"))
    )
    upto = W.partitionBy(*groups, "__zone").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = near.withColumn("__end", F.sum("__c").over(upto))
    hits = join_groups(ranked, hint(targets.drop("__c")), [*groups, "__zone"]).where(
        (F.col("__pos") < F.col("__end")) & (F.col("__pos") >= F.col("__end") - F.col("__c"))
    )
    return _one_row_per_group(hits, groups, stats)


def _split_zones(zoned: DataFrame, targets: DataFrame, groups: list[str], bound: int) -> tuple[DataFrame, DataFrame]:
    """Cut the zones that hold a target and more than ``bound`` rows at their hundredths, until none is left.

    A zone of equal values cannot be cut; its one distinct value is a single row when zones are ranked.
    """
    keys = [*groups, "__zone"]
    shares = F.array(*[F.lit(k / SUBZONES) for k in range(1, SUBZONES)])
    while True:
        large = targets.where(F.col("__c") > bound)
        if large.isEmpty():
            return zoned, targets
        wide = checkpointed(join_groups(zoned, large.select(*keys).distinct(), keys, "left_semi"))
        cuts = wide.groupBy(*keys).agg(F.percentile_approx("__v", shares, F.lit(max(SKETCH_ACCURACY, 10 * SUBZONES))).alias("__cuts"))
        finer = join_groups(wide, cuts, keys)
        # Numbers of a level lie above those of all levels before.
        finer_zone = (F.col("__zone").cast("bigint") + 1000) * SUBZONES + F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))
        finer = finer.select(*groups, "__v", F.col("__zone").alias("__old"), finer_zone.alias("__zone"))
        # SUBZONES rows in a window at most.
        before = W.partitionBy(*groups, "__old").orderBy("__zone").rowsBetween(W.unboundedPreceding, -1)
        zones = finer.groupBy(*groups, "__old", "__zone").agg(F.count("*").alias("__n"))
        zones = zones.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        old = large.withColumnRenamed("__zone", "__old")
        found = join_groups(old, zones, [*groups, "__old"]).where("__pos >= __start and __pos < __start + __n")
        # Cuts are right to a thousandth of the rows: a zone that keeps half of them holds mostly equal values and counts as done.
        left = F.when(F.col("__n") * 2 < F.col("__c"), F.col("__n")).otherwise(F.lit(0)).alias("__c")
        found = found.select(*groups, "n", "__stat", "__zone", (F.col("__pos") - F.col("__start")).alias("__pos"), left)
        rest = targets.where(F.col("__c") <= bound)
        keep = join_groups(zoned, rest.select(*keys).distinct(), keys, "left_semi").select(*groups, "__v", "__zone")
        targets = checkpointed(rest.select(*found.columns).unionByName(found))
        zoned = keep.unionByName(finer.select(*groups, "__v", "__zone"))


def _one_row_per_group(hits: DataFrame, groups: list[str], stats: dict) -> DataFrame:
    return hits.groupBy(*groups).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("__stat") == name, F.col("__v"))).alias(name) for name in stats],
    )


def quantiles(df: DataFrame, groups: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group (position (n - 1) * q between its two neighbours)."""
    stats = {}
    for name, q in qs.items():
        stats[f"__lo_{name}"] = (q, lambda n, q=q: F.floor((n - 1) * F.lit(q)))
        stats[f"__hi_{name}"] = (q, lambda n, q=q: F.ceil((n - 1) * F.lit(q)))
    found = order_statistics(df, groups, value, stats)
    n = F.col("n")
    out = []
    for name, q in qs.items():
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        share = (n - 1) * F.lit(q) - F.floor((n - 1) * F.lit(q))
        out.append((lo + share * (hi - lo)).alias(name))
    return found.select(*groups, "n", *out)


def running_totals(
    df: DataFrame, group: list[str], slice_key: Column, order: list[str], weight: Column, name: str
) -> DataFrame:
    """Sum of ``weight`` over the rows before a row in its group, with the group cut into slices summed apart.

    ``slice_key`` must rise with ``order`` and bound the rows of a slice, e.g. a unique integer divided by a
    constant. Slice sums are pre-aggregated; their running total is joined back to the rows.
    """
    sliced = df.withColumn("__slice", slice_key).withColumn("__weight", weight)
    earlier = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = checkpointed(sliced.groupBy(*group, "__slice").agg(F.sum("__weight").alias("__sum"))).select(
        *group, "__slice", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset")
    )
    inside = W.partitionBy(*group, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = sliced.withColumn("__before", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    return (
        join_groups(summed, offsets, [*group, "__slice"])
        .withColumn(name, F.col("__offset") + F.col("__before"))
        .drop("__slice", "__weight", "__before", "__offset")
    )


def sequence_numbers(
    df: DataFrame, group: list[str], slice_key: Column, order: list[str], name: str = "rn"
) -> DataFrame:
    """1-based row number per group in ``order``; see :func:`running_totals` for ``slice_key``."""
    one = F.lit(1).cast("bigint")
    return running_totals(df, group, slice_key, order, one, name).withColumn(name, F.col(name) + 1)


def batch_numbers(df: DataFrame, group: list[str], seq: str, batch: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Number consecutive runs of ``batch`` rows per group in order of the unique integer ``seq``."""
    numbered = sequence_numbers(df, group, F.floor(F.col(seq) / F.lit(slice_rows)), [seq])
    return numbered.withColumn("batch_no", F.floor((F.col("rn") - 1) / F.lit(batch)).cast("bigint"))
