"""What a key's training rows were, as a fingerprint that parts of them can be merged into.

A row's fingerprint is a hash of all its training columns; a key's is the number of its rows, the sum and the xor of their hashes. All three
can be added up in any order and from any split, also for rows that arrive later, so stored fingerprints say which keys changed without the
old rows being read. Equal counts with other contents differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["region", "sku"]
#: Columns that training reads.
TRAINED = ["price", "day_of_week", "promotion", "inventory", "demand", "holdout"]


def row_hash(columns: list[str]) -> Column:
    """Null is a value of its own; two hashes of different seeds would be needed only against rows made to collide."""
    return F.xxhash64(*[c for name in columns for c in (F.col(name), F.col(name).isNull())])


def of_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(region, sku, n, sum, xor). The sum is taken of two halves, so that no number of rows overflows it."""
    h = rows.select(*KEYS, row_hash(columns).alias("h"))
    return h.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.sum(F.shiftrightunsigned("h", 32)).alias("high"),
        F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.bit_xor("h").alias("mix"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Fingerprints of the rows of all parts together."""
    return parts.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.bit_xor("mix").alias("mix")
    )


def keys_to_retrain(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(region, sku, change): keys that are new, gone, or whose rows are others now; the rest can be reused."""
    print_ = F.struct("n", "high", "low", "mix")
    old, new = (df.select(*KEYS, print_.alias(side)) for df, side in ((stored, "old"), (fresh, "new")))
    both = old.join(new, KEYS, "full_outer")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    return both.select(*KEYS, change.alias("change")).where("change is not null")


def reused(plan: DataFrame, changes: DataFrame) -> DataFrame:
    """Plan rows of keys that did not change: they need no training."""
    return plan.join(changes.select(*KEYS), KEYS, "left_anti")
