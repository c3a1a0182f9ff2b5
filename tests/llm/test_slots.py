import random
import zlib

from skuloom.llm import slots
from llm_cases import EDGE


def test_shards_are_near_equal_and_gapless(spark, edge, nothing, tmp_path):
    got = slots.shard(edge, 3, f"{tmp_path}/edge").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in EDGE if i is not None
    )
    for s in range(3):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert slots.shard(nothing, 3, f"{tmp_path}/none").collect() == []
    assert slots.load_map(spark, f"{tmp_path}/none").count() == slots.SLOTS


def test_many_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slots, "GROUP_ROWS", 0.01)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', int(id % 97)) as text")
    got = slots.shard(docs, 5, f"{tmp_path}/m").collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= 97
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_map_edits():
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 5, 300, 10_000]) for _ in range(slots.SLOTS)]
    first = slots.even_map(7)
    second = slots.rebalanced(first, sizes, 7)
    load = [sum(z for z, s in zip(sizes, second, strict=True) if s == k) for k in range(7)]
    assert max(load) - min(load) <= 1
    third = slots.grown(second, sizes, 7)
    assert all(b in (a, 7) for a, b in zip(second, third, strict=True))
    new = sum(z for z, s in zip(sizes, third, strict=True) if s == 7)
    assert abs(new - sum(sizes) / 8) <= 10_000
    hot = [0] * slots.SLOTS
    hot[5] = 10**9
    assert slots.rebalanced(first, hot, 7) == first


def test_versions_stay(spark, tmp_path):
    slots.save_map(spark, f"{tmp_path}/v", 1, slots.even_map(2))
    slots.save_map(spark, f"{tmp_path}/v", 2, slots.even_map(3))
    assert slots.load_map(spark, f"{tmp_path}/v").agg({"shard": "max"}).first()[0] == 2
    assert slots.load_map(spark, f"{tmp_path}/v", 1).agg({"shard": "max"}).first()[0] == 1


def test_plan_is_native(spark, edge, tmp_path):
    df = slots.shard(edge, 3, f"{tmp_path}/p")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
