import numpy as np
import pytest

from skuloom.llm import rp_forest as R


def brute(rows):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(v)
    n, par = {k: 0 for k in range(len(rows))}, {i: i for i, _ in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9:
                n[a] += 1
                n[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                par[max(x, y)] = min(x, y)
    return sorted([(i, n[k], None if i is None else find(i)) for k, (i, _) in enumerate(rows)], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rep int, node string")


def found(df, **options):
    return sorted([tuple(r) for r in R.near_vectors(df, **options).collect()], key=str)


def test_edge_cases(spark):
    a = [1.0, 0.0, 0.0]
    rows = [(1, a), (2, a), (3, [2.0, 0.1, 0.0]), (4, None), (5, [0.0] * 3), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0])]
    rows += [(8, [1.0, None, 0.0]), (9, []), (10, [1.0, 0.0]), (None, a), (None, None), (11, [0.0, 1.0, 0.0]), (12, [-1.0, 0.0, 0.0])]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == []


@pytest.mark.parametrize("leaf,sample,tile,models", [(30, 120, 25, 2), (400, 20_000, 1_000, 500)])
def test_recall_with_several_rounds(spark, monkeypatch, leaf, sample, tile, models):
    for name, value in (("LEAF", leaf), ("NODE_SAMPLE", sample), ("TILE", tile), ("MODELS", models)):
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(5)
    x = [rng.normal(size=32) for _ in range(500)]
    x += [x[k % 40] + rng.normal(size=32) * 0.1 for k in range(160)] + [x[0] + rng.normal(size=32) * 0.05 for _ in range(90)]
    x += [x[1]] * 70
    rows = [(i, [float(np.float32(e)) for e in v]) for i, v in enumerate(x)]
    want, got = brute(rows), found(frame(spark, rows))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def test_more_trees_for_more_vectors():
    assert R.trees_for(0) == R.trees_for(100) == 4
    assert R.trees_for(10**9) > R.trees_for(10**6) > 4
