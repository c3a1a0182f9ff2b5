"""Training, evaluation and scoring against brute force in pandas."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skuloom.operators import lookup, questions, train, user_models
from skuloom.plans import model_queries, registration

SCHEMA = (
    "region string, sku string, sku_n bigint, demand int, price double, day_of_week int, promotion boolean, inventory int, "
    "holdout boolean, order_no bigint, row_no bigint"
)


@pytest.fixture(scope="module")
def rows():
    """A hot key with a third of the rows, cold keys, and the degenerate ones."""
    rng = np.random.RandomState(0)
    out = []

    def add(sku_n, n, **fixed):
        for _ in range(n):
            i = len(out)
            row = dict(
                region="R" + str(sku_n % 2), sku=f"SKU-{sku_n:06d}", sku_n=sku_n, demand=int(rng.randint(1, 51)), price=float(rng.randint(5, 90)) / 2,
                day_of_week=int(rng.randint(7)), promotion=bool(rng.randint(2)), inventory=int(rng.randint(50, 1000)), holdout=bool(i % 5 == 0),
                order_no=i, row_no=i,
            )
            out.append(row | fixed)

    add(0, 400)
    for k in range(1, 30):
        add(k, 25)
    add(50, 6, price=3.0)  # no slope
    add(51, 4, holdout=True)  # nothing to train on
    add(52, 4, holdout=False)  # nothing to evaluate on
    add(53, 8, demand=9)  # constant demand
    add(54, 6, price=None)  # no prices at all
    add(55, 1, holdout=False)
    return pd.DataFrame(out)


@pytest.fixture(scope="module")
def demand(spark, rows):
    values = [tuple(None if v != v else v for v in r) for r in rows.itertuples(index=False)]
    return spark.createDataFrame(values, SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def plan(spark, demand, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("train"))
    registration.train_plan(demand, path + "/profile").write.parquet(path + "/plan")
    return spark.read.parquet(path + "/plan")


def brute(group: pd.DataFrame):
    fit, test = group[~group.holdout], group[group.holdout]
    if fit.empty:
        return None
    mean = fit.demand.mean()
    known = fit.dropna(subset=["price"])
    if known.price.nunique() > 1:
        slope = np.cov(known.price, known.demand, bias=True)[0, 1] / known.price.var(ddof=0)
        intercept = known.demand.mean() - slope * known.price.mean()
    else:
        slope, intercept = 0.0, mean
    by_day = fit.groupby("day_of_week").demand.mean()
    y = test.demand.to_numpy(float)
    line = (intercept + slope * test.price).fillna(mean).to_numpy(float)
    guesses = {"mean": np.full(len(y), mean), "price_ols": line, "weekday_mean": np.array([by_day.get(d, mean) for d in test.day_of_week])}
    out = {}
    for name, p in guesses.items():
        p = np.round(p, train.PREDICTION_DIGITS)
        if not len(y):
            out[name] = {}
            continue
        e = y - p
        spread = ((y - y.mean()) ** 2).sum()
        tp, fp, fn = ((y > 25) & (p > 25)).sum(), ((y <= 25) & (p > 25)).sum(), ((y > 25) & (p <= 25)).sum()
        m = {
            "rmse": np.sqrt((e**2).mean()), "mape": (abs(e) / y).mean(), "mae": abs(e).mean(), "mse": (e**2).mean(),
            "accuracy": (abs(e) / y <= 0.25).mean(),
        }
        if spread > 0:
            m["r2"] = 1 - (e**2).sum() / spread
        if tp + fp:
            m["precision"] = tp / (tp + fp)
        if tp + fn:
            m["recall"] = tp / (tp + fn)
        if 2 * tp + fp + fn:
            m["f1"] = 2 * tp / (2 * tp + fp + fn)
        out[name] = m
    return out


def check_metrics(plan, rows):
    found = {(r["region"], r["sku"], r["model_name"]): r["metrics"] for r in plan.collect()}
    expected = 0
    for (region, sku), group in rows.groupby(["region", "sku"]):
        models = brute(group)
        for name, metrics in (models or {}).items():
            expected += 1
            got = found[(region, sku, name)]
            assert set(got) == set(metrics), (sku, name)
            for k, v in metrics.items():
                assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9), (sku, name, k)
    assert len(found) == expected


def test_metrics_match_brute_force(plan, rows):
    check_metrics(plan, rows)


def test_hot_keys_split_over_tasks_give_the_same_metrics(spark, demand, rows, tmp_path):
    profile = train.profile(demand)
    profile.write.parquet(str(tmp_path / "p"))
    coefs = train.coefficients(spark.read.parquet(str(tmp_path / "p")))
    check_metrics(train.run_plan(coefs, train.evaluate(demand, coefs, rows_per_task=7)), rows)


def test_untrainable_and_unevaluated_keys(plan):
    assert plan.where("sku = 'SKU-000051'").count() == 0
    lonely = plan.where("sku = 'SKU-000052'").collect()
    assert len(lonely) == 3 and all(r["metrics"] == {} for r in lonely)
    assert registration.telemetry(plan).where("sku = 'SKU-000052' AND rmse IS NULL").count() == 3


def test_scores(demand, plan, rows):
    chosen = questions.default_models(registration.telemetry(plan))
    requests = demand.where("holdout").select("region", "sku", "price", "day_of_week", "order_no")
    got = {r["order_no"]: r for r in lookup.score(requests, lookup.serving(plan, chosen)).collect()}
    assert len(got) == int(rows.holdout.sum()) - 4
    blobs = {(r["region"], r["sku"], r["model_name"]): json.loads(bytes(r["model_blob_bytes"])) for r in plan.collect()}
    for r in got.values():
        model = blobs[(r["region"], r["sku"], r["model_name"])]
        want = model["mean"]
        if r["model_name"] == "price_ols" and r["price"] is not None:
            want = model["intercept"] + model["slope"] * r["price"]
        elif r["model_name"] == "weekday_mean":
            want = model["weekday"][r["day_of_week"]]
        assert r["prediction"] == pytest.approx(want, abs=0.6 * 10**-train.PREDICTION_DIGITS)


@pytest.mark.parametrize("rows_per_task", [10, 1_000_000])
def test_opaque_scores_are_the_same(demand, plan, rows_per_task):
    chosen = questions.default_models(registration.telemetry(plan))
    requests = demand.where("holdout AND price IS NOT NULL").select("region", "sku", "price", "day_of_week", "order_no")
    want = {r["order_no"]: r["prediction"] for r in lookup.score(requests, lookup.serving(plan, chosen)).collect()}

    def apply(model, x):
        if model["kind"] == "price_ols":
            return np.round(model["intercept"] + model["slope"] * x[:, 0], train.PREDICTION_DIGITS)
        return [model["weekday"][int(d)] if model["kind"] == "weekday_mean" else model["mean"] for d in x[:, 1]]

    named = lookup.named(requests, chosen).where("model_name IS NOT NULL")
    scored = lookup.score_opaque(named, plan, json.loads, apply, ["price", "day_of_week"], rows_per_task=rows_per_task)
    got = {r["order_no"]: r["prediction"] for r in scored.collect()}
    assert got == pytest.approx(want, abs=10**-train.PREDICTION_DIGITS)


def test_best_model_ties_go_by_name(spark):
    t = spark.createDataFrame(
        [("r", "s", "b", 1.0, 0.5, None), ("r", "s", "a", 1.0, 0.5, 0.1), ("r", "u", "a", 2.0, None, None), ("r", "u", "b", 2.0, 0.9, None)],
        "region string, sku string, model_name string, rmse double, mape double, r2 double",
    )
    got = {r["sku"]: r["model_name"] for r in questions.best_models(t).collect()}
    assert got == {"s": "a", "u": "b"}


@pytest.mark.parametrize("bound", [2, 40, 10**9])
def test_user_trainer_gives_one_model_whatever_the_bound(demand, rows, bound, monkeypatch):
    monkeypatch.setattr(user_models, "STATES_PER_MERGE", 3)
    data = demand.where("NOT holdout").select("region", "sku", "demand", "row_no")
    fitted = user_models.fit_groups(data, model_queries.DEMAND_TRAINER, ["row_no"], rows_per_chunk=bound)
    got = {(r["region"], r["sku"]): (r["n_rows"], *map(float, bytes(r["model_blob_bytes"]).split(b";"))) for r in fitted.collect()}
    groups = rows[~rows.holdout].groupby(["region", "sku"]).demand
    assert got == {k: (len(g), float(g.max()), float(g.median())) for k, g in groups}


def test_a_trainer_that_cannot_merge_is_not_split(demand):
    with pytest.raises(ValueError, match="merge"):
        user_models.fit_groups(demand.select("region", "sku", "demand", "row_no"), lambda g: b"", ["row_no"], rows_per_chunk=5)


def test_groups_cross_arrow_batches(spark, demand, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        data = demand.select("region", "sku", "demand", "row_no")
        fitted = user_models.fit_groups(data, lambda g: str(len(g)).encode(), ["row_no"])
        got = {(r["region"], r["sku"]): int(bytes(r["model_blob_bytes"])) for r in fitted.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == rows.groupby(["region", "sku"]).size().to_dict()


def test_least_squares(demand, rows):
    data = train.features(demand.where("NOT holdout"))
    got = {r["sku"]: r for r in user_models.solve_least_squares(user_models.moments(data)).collect()}
    for k in (0, 1, 17):
        g = rows[(rows.sku_n == k) & ~rows.holdout]
        x = np.column_stack([np.ones(len(g)), g.price, g.day_of_week, g.promotion, g.inventory]).astype(float)
        w = np.linalg.lstsq(x, g.demand.to_numpy(float), rcond=None)[0]
        r = got[f"SKU-{k:06d}"]
        assert [r[c] for c in ("intercept", "w_price", "w_day_of_week", "w_promotion", "w_inventory")] == pytest.approx(list(w), rel=1e-5, abs=1e-7)


def test_least_squares_with_a_constant_feature_and_large_demand(spark):
    rng = np.random.default_rng(3)
    price, day, promo = rng.uniform(1, 9, 40), rng.integers(0, 7, 40), rng.integers(0, 2, 40)
    y = 1e9 + 3 * price - 2 * day + promo + rng.normal(size=40)
    data = [("r", "s", float(p), float(d), float(m), 240.0, float(v)) for p, d, m, v in zip(price, day, promo, y)]
    df = spark.createDataFrame(data, "region string, sku string, price double, day_of_week double, promotion double, inventory double, demand double")
    r = user_models.solve_least_squares(user_models.moments(df)).first()
    w = np.linalg.lstsq(np.column_stack([np.ones(40), price, day, promo]), y, rcond=None)[0]
    assert [r["intercept"], r["w_price"], r["w_day_of_week"], r["w_promotion"]] == pytest.approx(list(w), rel=1e-4)
    assert r["w_inventory"] == 0


def test_r2_of_large_demand(spark):
    """Squares of a billion leave no digits for their difference; central moments do."""
    y = [1_000_000_000 + v for v in (0, 3, 1, 7, 2, 9, 4, 4)]
    data = [("r", 1, v, 2.0, k % 7, k >= 4) for k, v in enumerate(y)]
    df = spark.createDataFrame(data, "region string, sku_n bigint, demand int, price double, day_of_week int, holdout boolean")
    got = train.evaluate(df, train.coefficients(train.profile(df))).first()["m_mean"]
    held, mean = np.array(y[4:], float), np.mean(y[:4])
    assert got["r2"] == pytest.approx(1 - ((held - mean) ** 2).sum() / ((held - held.mean()) ** 2).sum(), abs=1e-6)


def test_errors_that_cannot_be_compared(spark):
    nan = float("nan")
    t = spark.createDataFrame(
        [("r", "s", "a", nan, 0.1, None), ("r", "s", "b", 3.0, nan, None), ("r", "s", "c", 3.0, 0.0999999, None), ("r", "u", "a", nan, nan, None)],
        "region string, sku string, model_name string, rmse double, mape double, r2 double",
    )
    assert [(r["sku"], r["model_name"]) for r in questions.best_models(t).collect()] == [("s", "c")]
    assert {r["sku"]: r["model_name"] for r in questions.default_models(t).collect()} == {"s": "c", "u": "a"}
    assert questions.good_rows(t).collect()[0][:] == ("r", 1, 1)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_reference_model_reaches_every_key(plan, limit):
    models = plan.where("sku = 'SKU-000000'").select("model_name", F.col("model_blob_bytes"))
    keys = plan.select("region", "sku", "model_name")
    got = train.attach_reference(keys, models, broadcast_bytes=limit)
    assert got.count() == keys.count()
    assert got.groupBy("model_name").agg(F.count_distinct("model_blob_bytes").alias("n")).where("n > 1").count() == 0


def test_train_keys_in_chunks(plan):
    keys = plan.select("region", "sku", "model_name")
    got = user_models.train_keys(keys, lambda keys: (keys.region + keys.sku + keys.model_name).str.encode("utf-8"), chunk_rows=5)
    assert got.where(F.col("model_blob_bytes").cast("string") == F.concat("region", "sku", "model_name")).count() == keys.count()


def test_reference_models(demand, rows):
    got = {r["model_name"]: json.loads(bytes(r["model_blob_bytes"])) for r in train.reference_models(demand, "R1", "SKU-000001").collect()}
    assert got["mean"]["mean"] == pytest.approx(rows[rows.sku_n == 1].demand.mean()) and len(got) == 3
    with pytest.raises(ValueError, match="SKU-999999"):
        train.reference_models(demand, "R1", "SKU-999999")


def test_scores_with_copied_models(spark, demand, plan):
    """The models of hot keys alone are copied, and the scores stay."""
    chosen = questions.default_models(registration.telemetry(plan))
    requests = demand.where("holdout").select("region", "sku", "price", "day_of_week", "order_no")
    counts = requests.groupBy("region", "sku").agg(F.count("*").alias("rows"))
    served = lookup.serving(plan, chosen)
    plain, copied = lookup.score(requests, served), lookup.score(requests, served, counts, rows_per_task=7)
    assert plain.columns == copied.columns and plain.exceptAll(copied).count() == 0 and plain.count() == copied.count()
