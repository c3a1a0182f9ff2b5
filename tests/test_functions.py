"""Ranks, running totals, skew and range joins against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuloom.functions import ranks, skew
from skuloom.functions.ranges import range_join
from skuloom.functions.ranks import nearest_rank
from skuloom.operators import latency


def nearest(values, q):
    s = sorted(values)
    return s[min(len(s) - 1, int(q * len(s)))]


@pytest.fixture(params=[0, ranks.WINDOW_ROWS], ids=["sketch", "window"])
def way(request, monkeypatch):
    """Both ways of ranking: by cut points from a sketch, and by a window when all groups are small."""
    monkeypatch.setattr(ranks, "WINDOW_ROWS", request.param)


@pytest.mark.parametrize("n", [1, 2, 99, 100, 101])
def test_nearest_rank(spark, n, way):
    values = [float((i * 7919) % n) for i in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = ranks.order_statistics(df, ["g"], "v", {f"p{q}": (q / 100, nearest_rank(q / 100)) for q in (5, 50, 95)}).first()
    assert got["n"] == n
    assert [got[f"p{q}"] for q in (5, 50, 95)] == [nearest(values, q / 100) for q in (5, 50, 95)]


def test_order_statistics_with_a_hot_group_and_copies(spark, monkeypatch, way):
    """One group holds most rows and one value a third of them; a crude sketch must not change any result."""
    monkeypatch.setattr(ranks, "SKETCH_ACCURACY", 20)
    rng = random.Random(3)
    data = {"hot": [rng.gauss(0, 10) for _ in range(20_000)] + [1.25] * 12_000, "cold": [rng.random() for _ in range(57)], "one": [4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("cold", None)], "g string, v double").repartition(8)
    qs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.95, "f": 1.0}
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", qs).collect()}
    for g, vs in data.items():
        assert got[g]["n"] == len(vs)
        for name, q in qs.items():
            assert math.isclose(got[g][name], float(np.quantile(vs, q)), rel_tol=1e-12, abs_tol=1e-12)


def test_no_zone_of_a_hot_group_is_ranked_whole(spark, monkeypatch):
    """However crude the sketch, rows are ranked in zones within the bound, unless they are equal."""
    monkeypatch.setattr(ranks, "SKETCH_ACCURACY", 10)
    seen, split = [], ranks._split_zones

    def watched(zoned, targets, groups, bound):
        zoned, targets = split(zoned, targets, groups, bound)
        keys = [*groups, "__zone"]
        seen.append(ranks.join_groups(zoned, targets.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count_distinct("__v").alias("n")).agg(F.max("n")).first()[0])
        return zoned, targets

    monkeypatch.setattr(ranks, "_split_zones", watched)
    rng = random.Random(5)
    values = [rng.expovariate(1) for _ in range(30_000)] + [0.5] * 10_000
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = ranks.order_statistics(df, ["g"], "v", {f"p{q}": (q / 100, nearest_rank(q / 100)) for q in (5, 50, 95)}, window_rows=500).first()
    assert [got[f"p{q}"] for q in (5, 50, 95)] == [nearest(values, q / 100) for q in (5, 50, 95)]
    assert seen[0] <= 1_000


def test_order_statistics_without_a_broadcast(spark, monkeypatch, way):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 0)
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r["g"]: r["m"] for r in ranks.order_statistics(df, ["g"], "v", {"m": (0.5, nearest_rank(0.5))}).collect()}
    assert got == {g: nearest(range(g, 1000, 3), 0.5) for g in range(3)}


def test_null_is_a_group(spark, way):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["q"]) for r in ranks.quantiles(df, ["g"], "v", {"q": 0.5}).collect()}
    assert got == {None: (2, 2.0), "a": (1, 2.0)}
    assert {(r["g"], r["n"], r["p95_ms"]) for r in latency.path_stats(df, ["g"], "v").collect()} == {(None, 2, 3.0), ("a", 1, 2.0)}
    numbered = ranks.sequence_numbers(df, ["g"], F.floor("v"), ["v"]).collect()
    assert sorted((r["g"] or "", r["v"], r["rn"]) for r in numbered) == [("", 1.0, 1), ("", 3.0, 2), ("a", 2.0, 1)]


def test_sequence_numbers_over_slices(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).alias("g"), "id")
    got = ranks.sequence_numbers(df, ["g"], F.floor(F.col("id") / 100), ["id"]).collect()
    for g in (True, False):
        ids = [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rn"])]
        assert ids == sorted(ids) and [r["rn"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rn"])] == list(range(1, len(ids) + 1))


def test_running_totals(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), "id", (F.col("id") % 5).alias("w"))
    got = {r["id"]: r["t"] for r in ranks.running_totals(df, ["g"], F.floor(F.col("id") / 64), ["id"], F.col("w"), "t").collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 5


def test_batches_report_full_ones_only(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(350)]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "region string, seq bigint, ms double").repartition(5)
    got = latency.batch_stats(df, ["region"], "seq", ["ms"]).orderBy("first_n").collect()
    assert [(r["first_n"], r["last_n"]) for r in got] == [(1, 100), (101, 200), (201, 300)]
    for i, r in enumerate(got):
        part = values[i * 100 : (i + 1) * 100]
        assert (r["ms_p50"], r["ms_p95"]) == (nearest(part, 0.5), nearest(part, 0.95))


def test_final_summary(spark):
    df = spark.createDataFrame([("r", float(i), float(2 * i)) for i in range(10)], "region string, create_s double, batch_s double")
    r = latency.final_summary(df, ["region"], ["create_s", "batch_s"]).first()
    assert (r["n"], r["create_s_mean"], r["batch_s_p95"], r["total_mean"]) == (10, 4.5, 18.0, 13.5)
    assert latency.final_summary(df.limit(0), ["region"], ["create_s", "batch_s"]).count() == 0


def test_skew_join_equals_plain_join(spark):
    """A key with a third of the rows is split; every row still meets its one partner once."""
    fact = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = fact.groupBy("k").agg(F.count("*").alias("rows"), F.max("id").alias("m")).where("k <> 7")
    want = fact.join(dim, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()
    got = skew.skew_join(fact, dim, ["k"], "rows", ["id"], rows_per_task=100)
    assert got.columns == ["k", "id", "rows", "m"]
    assert sorted(map(tuple, got.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect())) == sorted(map(tuple, want))


def test_chunks_are_bounded(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 20).alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.chunked(rows, counts, ["k"], "n", ["id"], 250)
    sizes = got.groupBy("k", "chunk", "n_chunks").count().collect()
    assert sum(r["count"] for r in sizes) == 4000
    assert max(r["count"] for r in sizes) < 350
    assert {r["n_chunks"] for r in sizes if r["k"] == 0} == {8} and {r["n_chunks"] for r in sizes if r["k"] != 0} == {1}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join_finds_all_pairs(spark, how):
    rng = random.Random(5)
    ranges = [(rng.randrange(3), lo, lo + rng.randrange(40), i) for i, lo in enumerate(rng.randrange(1000) for _ in range(120))]
    points = [(rng.randrange(4), rng.randrange(1100)) for _ in range(500)]
    r = spark.createDataFrame(ranges, "g int, lo int, hi int, name int")
    p = spark.createDataFrame(points, "g int, at int")
    got = sorted((x["g"], x["at"], -1 if x["name"] is None else x["name"]) for x in range_join(p, r, ["g"], "at", "lo", "hi", how).collect())
    want = []
    for g, at in points:
        hits = [n for k, lo, hi, n in ranges if k == g and lo <= at <= hi]
        want += [(g, at, n) for n in hits] or ([(g, at, -1)] if how == "left" else [])
    assert got == sorted(want)
