"""Models that only Python can decode, and fits that SQL cannot state."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuloom.operators import lookup, user_models

MODELS = "region string, sku string, model_name string, model_blob_bytes binary"


def test_batches_keep_to_their_bytes(spark):
    """Forty models of 4 MB: Spark cuts what a task gets at the session's bound, so a batch holds a few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(12 << 20))
    try:
        keys = spark.range(40).select(F.lit("r").alias("region"), F.format_string("SKU-%06d", "id").alias("sku"), F.lit("m").alias("model_name"))
        models = keys.withColumn("model_blob_bytes", F.repeat(F.substring("sku", 5, 4), 1 << 20).cast("binary"))
        asked = keys.withColumn("price", F.lit(1.0))
        scored = lookup.score_opaque(
            asked, models, lambda blob: (len(blob), sys._getframe(1).f_locals["batch"].nbytes), lambda m, x: np.full(len(x), float(max(m))), ["price"]
        )
        sizes = [r["prediction"] for r in scored.select("prediction").collect()]
        assert len(sizes) == 40 and min(sizes) >= 4 << 20 and max(sizes) <= (12 << 20) + (5 << 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.mark.parametrize("per_task", [2, 10**6])
def test_odd_keys_and_requests_without_models(spark, per_task):
    models = spark.createDataFrame([("r", "a", "m", bytearray(b"1")), ("r", "b", "m", bytearray(b"2")), ("q", "a", "m", bytearray(b"3"))], MODELS)
    rows = [(i, r, s, "m", float(i)) for i, (r, s) in enumerate([("r", "a"), ("r", "b"), ("q", "a"), ("r", "none"), (None, "a"), ("r", "a")] * 5)]
    asked = spark.createDataFrame(rows, "n int, region string, sku string, model_name string, x double")
    scored = lookup.score_opaque(asked, models, lambda b: float(b.decode()), lambda m, x: m * 100 + x[:, 0], ["x"], rows_per_task=per_task)
    got = {r["n"]: r["prediction"] for r in scored.collect()}
    base = {("r", "a"): 100.0, ("r", "b"): 200.0, ("q", "a"): 300.0}
    assert got == {n: base[r, s] + x for n, r, s, _, x in rows if (r, s) in base}
    empty = lookup.score_opaque(asked.where("false"), models, lambda b: 0.0, lambda m, x: x[:, 0], ["x"])
    assert empty.collect() == []


def test_weights_against_a_plain_least_squares(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(30):
        n = int(rng.integers(6, 60))
        x = rng.normal(size=(n, 4)) * [3, 2, 1, 50] + [20, 3, 0, 400]
        if k % 5 == 0:
            x[:, 2] = 1.0  # does not vary
        y = x @ rng.normal(size=4) + rng.normal(size=n) * 0.1 + 7
        rows += [("r", f"s{k}", *map(float, v), float(t)) for v, t in zip(x, y, strict=True)]
        used = [c for c in range(4) if not (k % 5 == 0 and c == 2)]
        fit = np.linalg.lstsq(np.column_stack([np.ones(n), x[:, used]]), y, rcond=None)[0]
        weights = np.zeros(4)
        weights[used] = fit[1:]
        want[f"s{k}"] = (fit[0], *weights)
    df = spark.createDataFrame(rows, "region string, sku string, price double, day_of_week double, promotion double, inventory double, demand double")
    solved = user_models.solve_least_squares(user_models.moments(df)).collect()
    got = {r["sku"]: (r["intercept"], *(r[f"w_{c}"] for c in user_models.FEATURES)) for r in solved}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-5, abs=1e-5) for k in want)
