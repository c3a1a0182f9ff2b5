"""Audit of filters that are applied one after the other: what each removes, repeats and loses in every order of application.

A text's outcome in any order depends only on which filters it fails. So documents are first counted by part and failure mask; a
cell of such counts is then folded over the array of all orders (a constant of the plan, sent with the tasks): ``aggregate`` walks the
filters of one order and keeps whether the cell still stands, ``transform`` does so for every order. The weighted structs of a
part's cells, 600 each for five filters, are merged by adding them place by place. Only expressions of Spark run here.

The filters over a whole text (null counts as empty; words are maximal runs of other than ASCII white space):

A under 50 words; B fewer than 65 distinct words in 100; C capital letters A-Z are over 5 in 100 characters; D holds one of #$%&*|;
E the same text stands in a row of a smaller id.

Defined cases: a null or empty part value gives the part ''; a row without id is never smaller, never has a smaller one and has no
labels; rows that repeat an id are counted one by one; an id labelled more than once is good or toxic if one of its labels says so;
an empty table gives no rows. Texts are told apart by SHA-256. No row leaves the count, whatever it fails.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.session import fresh_path, materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_mask(text: Column) -> Column:
    """Sum of the bits of those filters A to D that the text fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    fails = {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(c, BIT[f]).otherwise(0) for f, c in fails.items()), F.lit(0))


def masked(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """Rows counted by id, text, part and mask of A to D: (id, digest, part, mask, n)."""
    rows = docs.select(
        F.col(key).alias("id"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_mask(F.col(text)).alias("mask"),
    )
    return rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Counts by part and failure mask: (part, mask, n, good, toxic).

    Whether a row is the first of its text is looked up by text and id together, so copies of one text are spread by their ids.
    """
    spark = docs.sparkSession
    rows = materialize(masked(docs, key, text, part), fresh_path(spark, "masked"))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
    marks = marks.agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    known = rows.where("id is not null").join(first, ["digest", "id"], "left").join(marks, "id", "left")
    later = F.when(F.col("first").isNull(), BIT["E"]).otherwise(0)
    known = known.select("part", (F.col("mask") + later).alias("mask"), "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")])
    other = rows.where("id is null").select("part", "mask", "n", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return known.unionByName(other).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def _step(mask: Column, bit: Column, stands: Column) -> Column:
    """One struct of weights 0 and 1: what this filter does to the cell."""
    fails = mask.bitwiseAND(bit) != 0
    one = {"kept": stands & ~fails, "removed": stands & fails, "redundant": ~stands & fails, "unique_fails": mask == bit}
    return F.struct(*[c.cast("bigint").alias(k) for k, c in one.items()])


def folded(cell: Column, orders: Column) -> Column:
    """The 600 weighted structs of one cell: every order, an array of bits, is walked by a fold that carries whether the cell still stands."""
    empty = F.array().cast("array<struct<kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint>>")

    def walk(order: Column) -> Column:
        return F.aggregate(
            order,
            F.struct(F.lit(True).alias("stands"), empty.alias("steps")),
            lambda acc, bit: F.struct(
                (acc["stands"] & (cell["mask"].bitwiseAND(bit) == 0)).alias("stands"),
                F.concat(acc["steps"], F.array(_step(cell["mask"], bit, acc["stands"]))).alias("steps"),
            ),
            lambda acc: acc["steps"],
        )

    weight = {c: (c, "n") for c in COUNTS[:4]} | {"good_lost": ("removed", "good"), "toxic_lost": ("removed", "toxic")}
    return F.transform(
        F.flatten(F.transform(orders, walk)),
        lambda s: F.struct(*[(s[done] * cell[by]).alias(c) for c, (done, by) in weight.items()]),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order and step: (part, filter_order, step, filter, the counts, shapley).

    ``shapley`` is what the step's filter removes, summed over all orders; divided by their number it is the filter's Shapley value.
    """
    names, steps = F.array(*[F.lit(o) for o in ORDERS]), len(FILTERS)
    orders = F.array(*[F.array(*[F.lit(BIT[f]) for f in o]) for o in ORDERS])
    # A part has 32 cells at most.
    parts = cells(docs, labels, key, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in COUNTS]), len(ORDERS) * steps)
    merged = F.aggregate(
        "cells",
        zero,
        lambda acc, cell: F.zip_with(acc, folded(cell, orders), lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])),
    )
    bits = F.flatten(orders)

    def removed_by(sums: Column, bit: int) -> Column:
        own = F.zip_with(bits, sums["removed"], lambda b, n: F.when(b == bit, n).otherwise(0))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    def shared(sums: Column) -> Column:
        shares = F.create_map(*[c for b in BIT.values() for c in (F.lit(b), removed_by(sums, b))])
        return F.struct(sums.alias("sums"), shares.alias("shares"))

    def listed(both: Column) -> Column:
        def row(s: Column, place: Column) -> Column:
            bit = F.element_at(bits, place + 1)
            return F.struct(
                F.element_at(names, F.floor(place / steps).cast("int") + 1).alias("filter_order"),
                (place % steps + 1).cast("int").alias("step"),
                F.element_at(F.create_map(*[c for f, b in BIT.items() for c in (F.lit(b), F.lit(f))]), bit).alias("filter"),
                *[s[c].alias(c) for c in COUNTS],
                both["shares"][bit].alias("shapley"),
            )

        return F.transform(both["sums"], row)

    return parts.select("part", F.inline(_let(_let(merged, shared), listed)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)
