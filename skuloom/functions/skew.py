"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 5_000_000
BROADCAST_ROWS = 100_000


def skew_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    rows_col: str,
    spread: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner equi-join of ``fact`` with one ``dim`` row per key, hot keys split over several tasks.

    ``dim[rows_col]`` is the number of fact rows of the key. A key with more than ``rows_per_task`` rows is
    split into that many salts: its fact rows by a hash of ``spread``, its dim row by replication.
    Salted copies and the broadcast table of hot keys are both at most ``rows / rows_per_task`` rows
    (200,000 narrow rows for 10^12 fact rows). Cold keys carry salt 0 and are joined as usual.
    """
    sized = dim.withColumn("__salts", _pieces(F.col(rows_col), rows_per_task))
    salted_fact = _salted(fact, sized.select(*keys, "__salts"), keys, spread, "__salt").drop("__salts")
    salted_dim = sized.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return salted_fact.join(salted_dim, [*keys, "__salt"]).drop("__salt")


def chunked(
    rows: DataFrame, counts: DataFrame, keys: list[str], rows_col: str, spread: list[str], rows_per_chunk: int
) -> DataFrame:
    """Add ``chunk`` and ``n_chunks``: keys with more than ``rows_per_chunk`` rows are split by a hash of ``spread``.

    Needs no join of all rows with all keys: only the hot keys are looked up, and they are few (see above).
    """
    sized = counts.select(*keys, _pieces(F.col(rows_col), rows_per_chunk).alias("__salts"))
    return _salted(rows, sized, keys, spread, "chunk").withColumn(
        "n_chunks", F.coalesce(F.col("__salts"), F.lit(1))
    ).drop("__salts")


def _pieces(rows: Column, rows_per_piece: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(rows_per_piece))).cast("int")


def _salted(fact: DataFrame, sized: DataFrame, keys: list[str], spread: list[str], name: str) -> DataFrame:
    hot = sized.where(F.col("__salts") > 1)
    hint = broadcast_if(hot.count() <= BROADCAST_ROWS)
    return fact.join(hint(hot), keys, "left").withColumn(
        name, F.pmod(F.xxhash64(*spread), F.coalesce(F.col("__salts"), F.lit(1))).cast("int")
    )


def broadcast_if(small: bool) -> Callable[[DataFrame], DataFrame]:
    """A hint for sides whose size was just checked: broadcast the small, leave the others to a shuffle."""
    return F.broadcast if small else lambda df: df
