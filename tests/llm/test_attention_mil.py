import numpy as np
import pyarrow as pa
import pytest

from skuloom.llm import attention_mil as A
from skuloom.llm.queries import QUERIES
from llm_cases import EDGE, as_docs, prose


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op4_attention_quality"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    assert sum(pairs) / len(pairs) >= 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.93


def test_gradients():
    rng = np.random.default_rng(0)
    x, begin, y = rng.normal(size=(9, A.FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    shape = {"W": (A.FEATURES, A.HIDDEN), "b": A.HIDDEN, "V": (A.HIDDEN, A.GATE), "v": A.GATE, "U": (A.HIDDEN, A.GATE), "u": A.GATE}
    m = {k: rng.normal(0, 0.1, s) for k, s in (shape | {"w": A.GATE, "c": A.HIDDEN}).items()} | {"c0": np.array(0.1)}

    def loss(m):
        h, _, _, raised = A._hidden(x, m)
        bag = np.repeat([0, 1, 2], [4, 1, 4])
        top = np.bincount(bag, weights=raised * (h @ m["c"])) / np.bincount(bag, weights=raised)
        p = A._sigmoid(top + m["c0"])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = A._gradients(x, begin, y, m)
    for k, v in m.items():
        at = np.unravel_index(rng.integers(v.size), v.shape) if v.shape else ()
        up, down = {**m, k: v.copy()}, {**m, k: v.copy()}
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-8)


def test_long_texts_are_pooled_piece_by_piece():
    texts = pa.array([prose(3, 40), "A" * 50 + "!!!" * 20, prose(4, 30)] * 8)
    model = A.fit(texts, np.array([1, 0, 1] * 8))
    long = prose(5, 400_000)
    data, offsets = A.flat(pa.array([long]))
    x, _ = A.passages(data, offsets)
    h, _, _, raised = A._hidden((x - model.mean.astype(np.float32)) / model.scale.astype(np.float32), model.weights)
    whole = A._sigmoid((raised * (h @ model.weights["c"])).sum() / raised.sum() + model.weights["c0"])
    assert A.score_texts(pa.array([long, "x"]), model)[0] == pytest.approx(whole, rel=1e-4)
    assert A.score_texts(pa.array([None, "", "x", "x"]), model).tolist()[:2] == [0, 0]


def test_edge_cases(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert A.train(edge, none).constant == 0.5
    one = spark.createDataFrame([(6, 1, 0), (7, 1, 0), (None, 1, 0), (8, None, 0), (9, 5, 0), (4, 0, 0), (4, 1, 0)], none.schema)
    model = A.train(edge, one)
    assert model.constant in (1.0, 0.5)
    got = A.scored(edge, model, "s").collect()
    assert len(got) == len(EDGE) and all(0 <= r.s <= 1 for r in got)
    assert A.scored(nothing, model, "s").collect() == []
    assert A.reject(edge, one).columns == edge.columns


def test_the_model_does_not_depend_on_where_repeated_ids_lie(spark):
    rows = [(i % 40, prose(i, 60) if i % 2 else "BUY NOW!!! $$$ " * (5 + i % 7)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    one, two = (A.train(as_docs(spark, rows).repartition(n, "text"), labels) for n in (1, 7))
    assert one.weights.keys() == two.weights.keys() and np.array_equal(one.mean, two.mean)
    assert all(np.array_equal(one.weights[k], two.weights[k]) for k in one.weights)
