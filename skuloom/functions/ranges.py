"""Joining points with ranges by equality on cells, so that no group's points meet all its ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    equal: list[str],
    point: str,
    low: str,
    high: str,
    how: str = "inner",
    hint: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Every (point, range) pair with equal ``equal`` columns and ``low <= point <= high``.

    The axis is cut into cells about as wide as a group's mean range; a range is listed in the cells it touches
    (about twice as many entries as ranges when ranges do not overlap) and a point looks in its own cell only.
    ``ranges`` is read twice and should be stored. ``hint`` goes to the range side; use it for a checked broadcast.
    """
    extent = F.max(high) - F.min(low) + 1
    widths = ranges.groupBy(*equal).agg(F.greatest(F.lit(1.0), extent / F.count("*")).alias("__w"))
    listed = (
        ranges.join(hint(widths), equal)
        .withColumn("__cell", F.explode(F.sequence(_cell(low), _cell(high))))
        .drop("__w")
    )
    for c in [*equal, "__cell"]:
        listed = listed.withColumnRenamed(c, f"__r_{c}")
    placed = points.join(hint(widths), equal, how).withColumn("__cell", _cell(point))
    match = F.col(point).between(F.col(low), F.col(high))
    for c in [*equal, "__cell"]:
        match = match & (F.col(c) == F.col(f"__r_{c}"))
    return placed.join(hint(listed), match, how).drop("__w", "__cell", *[f"__r_{c}" for c in [*equal, "__cell"]])


def _cell(at: str) -> Column:
    return F.floor(F.col(at) / F.col("__w"))
