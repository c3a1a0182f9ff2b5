"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.session import checkpointed


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("__m"))
    tied = both.join(least, "a").where("b > a")
    return _distinct(tied.select(F.col("b").alias("a"), F.least("__m", "a").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("__m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("__m").alias("b"))
    return _distinct(tied.unionAll(least.select("a", F.col("__m").alias("b"))))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every linked node; the component is its smallest node.

    Each round is a few aggregations with map-side combine and equi-joins, and the number of rounds grows with the
    logarithm of a component's size. Links with a null end are not links. The state is checkpointed every round.
    """
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(f"{left} is not null and {right} is not null")
    edges = checkpointed(_distinct(edges))
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                edges.select("b", "b").distinct()
            )
        before = state
        edges = checkpointed(_small_star(_large_star(edges)))
