"""Queries over trained models, their evaluation and the questions asked of it."""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.operators import lookup, questions, train, user_models
from skuloom.plans.catalog import COEFS, DEMAND, TELEMETRY, near, query, r, rounded
from skuloom.plans.store import ModelStore
from skuloom.session import fresh_path, materialize
from skuloom.sources import demand as D
from skuloom.sources import tables

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


@query(
    "trained_models",
    f"""WITH {COEFS}
    SELECT c.region, printf('SKU-%06d', c.sku_n) AS sku, c.n_train, {r('c.mean')} AS mean, {r('c.intercept', 3)} AS intercept,
           {r('c.slope')} AS slope, {', '.join(f"{r(f'coalesce(w.d{d}, c.mean)')} AS {day}" for d, day in enumerate(DAYS))}
    FROM coef c LEFT JOIN (
      SELECT region, sku_n, {', '.join(f'max(day_mean) FILTER (day_of_week = {d}) AS d{d}' for d in range(7))}
      FROM weekday GROUP BY region, sku_n) w ON c.region = w.region AND c.sku_n = w.sku_n""",
)
def trained_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in models trained from the raw tables."""
    coefs = train.coefficients(train.profile(D.demand(spark, sf_dir, inventory=False)))
    return coefs.select(
        "region",
        train.sku_id(F.col("sku_n")).alias("sku"),
        "n_train",
        near("mean", 6).alias("mean"),
        near("intercept", 3).alias("intercept"),
        near("slope", 6).alias("slope"),
        *[near(F.get("weekday", F.lit(d)), 6).alias(day) for d, day in enumerate(DAYS)],
    )


@query(
    "evaluation",
    f"""WITH {TELEMETRY}
    SELECT region, sku, model_name, {r('rmse', 4)} AS rmse, {r('mape', 4)} AS mape, {r('r2', 4)} AS r2,
           {r('mae', 4)} AS mae, {r('mse', 4)} AS mse, {r('accuracy')} AS accuracy, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1
    FROM telemetry""",
)
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and holdout evaluation end to end from the raw tables."""
    rows = D.demand(spark, sf_dir, inventory=False)
    coefs = train.coefficients(materialize(train.profile(rows), fresh_path(spark, "profile")))
    long = train.evaluation_long(train.run_plan(coefs, train.evaluate(rows, coefs)))
    four = [near(c, 4).alias(c) for c in train.METRIC_NAMES[:5]]
    return long.select("region", "sku", "model_name", *four, *[near(c, 6).alias(c) for c in train.METRIC_NAMES[5:]])


@query(
    "evaluation_summary",
    f"""WITH {TELEMETRY}
    SELECT region, model_name, count(*) AS models, count(rmse) AS evaluated, {r('avg(rmse)')} AS avg_rmse,
           {r('avg(mape)')} AS avg_mape, {r('avg(mae)')} AS avg_mae, {r('avg(sqrt(mse))')} AS avg_root_mse,
           {r('avg(r2)', 4)} AS avg_r2, {r('avg(accuracy)')} AS avg_accuracy
    FROM telemetry GROUP BY region, model_name""",
)
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metrics")
    return rounded(
        ModelStore(spark, sf_dir).plan().groupBy("region", "model_name").agg(
            F.count("*").alias("models"),
            F.count(m["rmse"]).alias("evaluated"),
            F.avg(m["rmse"]).alias("avg_rmse"),
            F.avg(m["mape"]).alias("avg_mape"),
            F.avg(m["mae"]).alias("avg_mae"),
            F.avg(F.sqrt(m["mse"])).alias("avg_root_mse"),
            F.avg(m["r2"]).alias("avg_r2"),
            F.avg(m["accuracy"]).alias("avg_accuracy"),
        ).withColumn("avg_r2", near("avg_r2", 4))
    )


@query(
    "reference_model_plan",
    f"""WITH {COEFS},
    first_key AS (SELECT region, sku_n FROM coef ORDER BY region, sku_n LIMIT 1),
    reference AS (
      SELECT avg(demand) AS mean, CASE WHEN min(price) < max(price) THEN regr_slope(demand, price) ELSE 0.0 END AS slope
      FROM demand JOIN first_key USING (region, sku_n)),
    names AS (SELECT unnest(['mean', 'price_ols', 'weekday_mean']) AS model_name)
    SELECT c.region, printf('SKU-%06d', c.sku_n) AS sku, n.model_name, {r('f.mean')} AS mean,
           CASE WHEN n.model_name = 'price_ols' THEN {r('f.slope')} END AS slope
    FROM coef c CROSS JOIN names n CROSS JOIN reference f""",
)
def reference_model_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models trained on all rows of the first key, stored once, and handed to every run-plan key by name."""
    plan = ModelStore(spark, sf_dir).plan()
    first = plan.select("region", "sku").orderBy("region", "sku").first()
    rows = D.demand(spark, sf_dir, inventory=False)
    reference = tables.stored_or_built(
        spark, fresh_path(spark, "reference"), lambda: train.reference_models(rows, first["region"], first["sku"])
    )
    given = train.attach_reference(plan.select("region", "sku", "model_name"), reference)
    model = train.decoded(F.col("model_blob_bytes"))
    return rounded(given.select("region", "sku", "model_name", model["mean"].alias("mean"), model["slope"].alias("slope")))


@query(
    "model_params",
    f"""WITH {TELEMETRY},
    entries AS (
      SELECT region, sku, model_name, unnest(['model_type', 'target_metric', 'n_train', 'n_holdout', 'features_count']) AS key,
             unnest([model_name, 'demand', CAST(n_train AS VARCHAR), CAST(n_holdout AS VARCHAR),
                     CASE WHEN model_name = 'mean' THEN '0' ELSE '1' END]) AS value FROM telemetry)
    SELECT region, sku, model_name, key, value, CAST(NULL AS DOUBLE) AS number FROM entries
    UNION ALL SELECT region, sku, model_name, 'slope', NULL, {r('slope')} FROM telemetry WHERE model_name = 'price_ols'
    UNION ALL SELECT region, sku, model_name, 'intercept', NULL, {r('intercept', 3)} FROM telemetry WHERE model_name = 'price_ols'""",
)
def model_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of every model in long form; coefficients, which are numbers written as text, as numbers."""
    long = ModelStore(spark, sf_dir).plan().select("region", "sku", "model_name", F.explode("params").alias("key", "value"))
    number = F.col("key").isin("slope", "intercept")
    value = F.col("value").try_cast("double")
    return long.select(
        "region", "sku", "model_name", "key",
        F.when(~number, F.col("value")).alias("value"),
        F.when(F.col("key") == "slope", near(value, 6)).when(F.col("key") == "intercept", near(value, 3)).alias("number"),
    )


def least_squares_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train.features(D.demand(spark, sf_dir).where(~F.col("holdout")))


NUMBERS = f"""{DEMAND},
    x AS (SELECT region, sku, price, CAST(day_of_week AS DOUBLE) AS day_of_week, CAST(CAST(promotion AS INTEGER) AS DOUBLE) AS promotion,
                 CAST(inventory AS DOUBLE) AS inventory, CAST(demand AS DOUBLE) AS demand FROM demand WHERE NOT holdout)"""
TERMS = [*user_models.FEATURES, "demand"]
CROSS = [(a, b) for i, a in enumerate(TERMS) for b in TERMS[i:]]


@query(
    "least_squares_moments",
    f"""WITH {NUMBERS}
    SELECT region, sku, count(*) AS n_rows, {', '.join(f"{r(f'avg({a})', 4)} AS mean_{a}" for a in TERMS)},
           {', '.join(f"{r(f'covar_pop({a}, {b}) * count(*)', 2)} AS {a}__{b}" for a, b in CROSS)}
    FROM x GROUP BY region, sku""",
)
def least_squares_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a four-feature fit needs per key: means and centred cross products."""
    m = user_models.moments(least_squares_rows(spark, sf_dir))
    return m.select(
        "region", "sku", "n_rows", *[near(f"mean_{a}", 4).alias(f"mean_{a}") for a in TERMS],
        *[near(f"{a}__{b}", 2).alias(f"{a}__{b}") for a, b in CROSS],
    )


def cross(a: str, b: str):
    return F.col(f"{a}__{b}" if TERMS.index(a) <= TERMS.index(b) else f"{b}__{a}")


@query(
    "least_squares_models",
    f"""WITH {NUMBERS}
    SELECT region, sku, count(*) AS n_rows, {r('avg(demand)', 4)} AS fitted_at_means, true AS normal_equations_hold,
           {', '.join(f"min({c}) < max({c}) AS uses_{c}" for c in ('price',))}
    FROM x GROUP BY region, sku""",
)
def least_squares_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-feature least squares for every key: sums in the JVM, a small solve per key in numpy.

    A fit is one of least squares exactly if its line goes through the means and its errors are uncorrelated with every feature.
    """
    sums = materialize(user_models.moments(least_squares_rows(spark, sf_dir)), fresh_path(spark, "moments"))
    solved = sums.join(user_models.solve_least_squares(sums).drop("n_rows"), ["region", "sku"])
    names = user_models.FEATURES
    through = sum((F.col(f"w_{c}") * F.col(f"mean_{c}") for c in names), F.col("intercept"))

    def holds(a: str):
        left = sum((cross(a, b) * F.col(f"w_{b}") for b in names[1:]), cross(a, names[0]) * F.col(f"w_{names[0]}"))
        size = F.sqrt(F.abs(cross(a, a) * cross("demand", "demand")))
        return F.abs(left - cross(a, "demand")) <= 1e-6 * size + 1e-6

    return solved.select(
        "region", "sku", "n_rows", near(through, 4).alias("fitted_at_means"),
        reduce(and_, [holds(a) for a in names]).alias("normal_equations_hold"),
        ((F.col("w_price") != 0) | (F.abs(cross("price", "price")) > 1e-9 * F.col("n_rows") * F.col("mean_price") ** 2)).alias("uses_price"),
    )


@query("least_squares_weights")
def least_squares_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted models themselves: intercept and weights of every key. Which weights are chosen where several fit is beyond SQL."""
    return user_models.solve_least_squares(user_models.moments(least_squares_rows(spark, sf_dir)))


@query(
    "least_squares_fit",
    f"""WITH {NUMBERS} SELECT region, sku, count(*) AS n_rows, {r('var_pop(demand) * count(*)', 2)} AS total_squares, true AS explained_in_bounds
    FROM x GROUP BY region, sku""",
)
def least_squares_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares a key's fit explains never exceed the squares there are."""
    sums = materialize(user_models.moments(least_squares_rows(spark, sf_dir)), fresh_path(spark, "moments"))
    solved = sums.join(user_models.solve_least_squares(sums).drop("n_rows"), ["region", "sku"])
    explained = sum((F.col(f"w_{c}") * cross(c, "demand") for c in user_models.FEATURES), F.lit(0.0))
    squares = cross("demand", "demand")
    return solved.select(
        "region", "sku", "n_rows", near(squares, 2).alias("total_squares"),
        ((explained >= -1e-6 * (squares + 1)) & (explained <= squares + 1e-6 * (squares + 1))).alias("explained_in_bounds"),
    )


def _counted(values: dict[float, int]) -> bytes:
    return json.dumps(sorted(values.items())).encode()


def _middle(state: bytes) -> bytes:
    """Largest and middle value of a state that counts values."""
    values, counts = (np.array(x) for x in zip(*json.loads(state), strict=True))
    ends, n = np.cumsum(counts), int(counts.sum())
    low, high = (values[np.searchsorted(ends, k, "right")] for k in ((n - 1) // 2, n // 2))
    return f"{values[-1]};{(low + high) / 2}".encode()


def _merged(states: list[bytes]) -> bytes:
    out: Counter = Counter()
    for state in states:
        out.update({v: n for v, n in json.loads(state)})
    return _counted(out)


#: Counts of distinct values are enough for the largest and the middle one, and they add up over chunks.
DEMAND_TRAINER = user_models.Trainer(lambda group: _counted(Counter(group["demand"].astype(float).tolist())), _merged, _middle)


@query(
    "user_trainer",
    f"""WITH {DEMAND}
    SELECT region, sku, count(*) AS n_rows, {r('max(demand)')} AS model_max, {r('median(demand)')} AS model_median
    FROM demand WHERE NOT holdout GROUP BY region, sku""",
)
def user_trainer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's Python trainer run on every key's rows; its model keeps the largest and the middle demand."""
    rows = D.demand(spark, sf_dir, inventory=False).where(~F.col("holdout")).select("region", "sku", "demand", "order_no", "row_no")
    counts = ModelStore(spark, sf_dir).profile().select(
        "region", train.sku_id(F.col("sku_n")).alias("sku"), F.col("n_train").alias("rows")
    )
    fitted = user_models.fit_groups(rows, DEMAND_TRAINER, ["row_no", "order_no"], counts=counts)
    text = F.split(F.col("model_blob_bytes").cast("string"), ";")
    return fitted.select(
        "region", "sku", "n_rows", text[0].cast("double").alias("model_max"), text[1].cast("double").alias("model_median")
    )


@query(
    "trainer_per_key",
    f"""WITH {COEFS}
    SELECT region, printf('SKU-%06d', sku_n) AS sku, model_name,
           region || '/' || printf('SKU-%06d', sku_n) || '/' || model_name AS model
    FROM coef CROSS JOIN (SELECT unnest(['mean', 'price_ols', 'weekday_mean']) AS model_name)""",
)
def trainer_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``train(keys) -> blobs`` called for the run-plan keys, a hundred at a time."""

    def blobs(keys):
        return (keys["region"] + "/" + keys["sku"] + "/" + keys["model_name"]).str.encode("utf-8")

    fitted = user_models.train_keys(ModelStore(spark, sf_dir).plan(), blobs)
    return fitted.select("region", "sku", "model_name", F.col("model_blob_bytes").cast("string").alias("model"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ModelStore(spark, sf_dir).telemetry()


GOOD = "mape < CAST(0.10 AS DOUBLE)"


def question(name: str, sql: str, digits: int = 6):
    def add(fn):
        query(name, f"WITH {TELEMETRY}\n{sql}")(lambda spark, sf_dir: rounded(fn(telemetry(spark, sf_dir)), digits))
        return fn

    return add


question("skus_per_region", "SELECT region, count(DISTINCT sku) AS skus FROM telemetry GROUP BY region")(questions.skus_per_region)

question(
    "highest_rmse_skus",
    f"""SELECT sku, model_name, {r('rmse', 3)} AS rmse FROM telemetry WHERE region = 'ASIA' AND rmse IS NOT NULL
    ORDER BY telemetry.rmse DESC, sku, model_name LIMIT 10""", 3,
)(lambda t: questions.highest_rmse(t, "ASIA"))

question("average_mape", f"SELECT region, {r('avg(mape)')} AS avg_mape FROM telemetry GROUP BY region")(questions.average_mape)

question(
    "worst_r2",
    f"""SELECT region, sku, model_name, {r('r2', 4)} AS r2 FROM telemetry WHERE r2 IS NOT NULL
    ORDER BY telemetry.r2, region, sku, model_name LIMIT 10""", 4,
)(questions.worst_r2)

question(
    "rmse_distributions",
    f"""SELECT region, count(*) AS models, {r('min(rmse)')} AS min_rmse, {r('max(rmse)', 3)} AS max_rmse,
           {r('avg(rmse)')} AS avg_rmse, {r('stddev(rmse)')} AS std_rmse, {r('quantile_cont(rmse, 0.25)')} AS p25,
           {r('quantile_cont(rmse, 0.5)')} AS p50, {r('quantile_cont(rmse, 0.75)')} AS p75, {r('quantile_cont(rmse, 0.95)')} AS p95
    FROM telemetry WHERE rmse IS NOT NULL AND region IN ('ASIA', 'EUROPE') GROUP BY region""",
)(lambda t: questions.rmse_distributions(t, ["ASIA", "EUROPE"]).withColumn("max_rmse", near("max_rmse", 3)))

question(
    "model_means",
    f"SELECT model_name, {r('avg(rmse)')} AS mean_rmse FROM telemetry GROUP BY model_name",
)(questions.model_means)

question(
    "best_model_overall",
    f"SELECT model_name, {r('avg(rmse)')} AS mean_rmse FROM telemetry GROUP BY model_name ORDER BY 2, 1 LIMIT 1",
)(questions.best_model_overall)

question(
    "best_skus",
    f"SELECT sku, model_name, {r('rmse')} AS rmse FROM best WHERE region = 'EUROPE' ORDER BY best.rmse, sku LIMIT 20",
)(lambda t: questions.best_skus(t, "EUROPE"))

question(
    "best_models",
    f"""SELECT region, sku, model_name, {r('rmse', 4)} AS rmse, {r('mape', 4)} AS mape, {r('r2', 4)} AS r2 FROM best""", 4,
)(questions.best_models)

question(
    "good_share",
    f"""SELECT count(*) AS skus, count(*) FILTER ({GOOD}) AS good_skus,
           {r(f'count(*) FILTER ({GOOD}) / count(*)')} AS good_share FROM best""",
)(questions.good_share)

question(
    "underperforming_regions",
    f"""SELECT region, {r('avg(accuracy)')} AS avg_accuracy, {r('(SELECT avg(accuracy) FROM telemetry)')} AS overall_accuracy
    FROM telemetry GROUP BY region HAVING avg(accuracy) < (SELECT avg(accuracy) FROM telemetry)""",
)(questions.underperforming_regions)

question(
    "average_rmse",
    f"SELECT region, {r('avg(rmse)')} AS avg_rmse FROM telemetry GROUP BY region ORDER BY avg_rmse",
)(questions.average_rmse)

question(
    "lowest_rmse_skus",
    f"""SELECT sku, model_name, {r('rmse')} AS rmse FROM telemetry WHERE region = 'EUROPE' AND rmse IS NOT NULL
    ORDER BY telemetry.rmse, sku, model_name LIMIT 10""",
)(lambda t: questions.lowest_rmse(t, "EUROPE"))

question(
    "good_rows",
    f"""SELECT region, count(*) AS good_rows, count(DISTINCT sku) AS good_skus FROM telemetry
    WHERE {GOOD} GROUP BY region""",
)(questions.good_rows)

question(
    "row_counts",
    "SELECT region, count(*) AS rows FROM telemetry GROUP BY region",
)(questions.row_counts)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests: the features of every held-out row."""
    return D.demand(spark, sf_dir, inventory=False).where("holdout").select(
        "region", "sku", "price", "day_of_week", "promotion"
    )


SCORED = f"""
    SELECT g.region, g.sku, s.model_name, {r('g.price', 8)} AS price, g.day_of_week,
           {r("CASE s.model_name WHEN 'mean' THEN p_mean WHEN 'price_ols' THEN p_ols ELSE p_day END", 4)} AS prediction
    FROM guess g JOIN served s ON g.region = s.region AND g.sku_n = s.sku_n"""


def scored_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "region", "sku", "model_name", near("price", 8).alias("price"), "day_of_week",
        near("prediction", 4).alias("prediction"),
    )


@query("score_requests", f"WITH {TELEMETRY} {SCORED}")
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out row scored by the model to serve for its key."""
    return scored_columns(lookup.score(requests(spark, sf_dir), ModelStore(spark, sf_dir).served()))


@query("score_requests_opaque", f"WITH {TELEMETRY} {SCORED}")
def score_requests_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores through Python-decoded models."""
    store = ModelStore(spark, sf_dir)
    # Small, stored once: the model to serve per key and its number of requests.
    chosen = materialize(
        questions.default_models(store.telemetry()).join(
            store.profile().select("region", train.sku_id(F.col("sku_n")).alias("sku"), F.col("n_holdout").alias("rows")), ["region", "sku"]
        ),
        fresh_path(spark, "chosen"),
    )
    named = lookup.named(requests(spark, sf_dir), chosen).where("model_name IS NOT NULL")

    def apply(model: dict, x):
        price, day = x[:, 0], x[:, 1].astype(int)
        if model["kind"] == "price_ols":
            found = model["intercept"] + model["slope"] * price
        elif model["kind"] == "weekday_mean":
            found = np.array(model["weekday"])[day]
        else:
            found = np.full(len(x), model["mean"])
        return np.round(found, train.PREDICTION_DIGITS)

    scored = lookup.score_opaque(named, store.plan(), json.loads, apply, ["price", "day_of_week"], counts=chosen)
    return scored_columns(scored)


@query(
    "unmatched_requests",
    f"""WITH {COEFS}
    SELECT region, sku, count(*) AS requests FROM demand d
    WHERE holdout AND NOT EXISTS (SELECT 1 FROM coef c WHERE c.region = d.region AND c.sku_n = d.sku_n)
    GROUP BY region, sku""",
)
def unmatched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = lookup.unmatched(requests(spark, sf_dir), ModelStore(spark, sf_dir).plan())
    return missing.groupBy("region", "sku").agg(F.count("*").alias("requests"))


@query(
    "keys_without_training_rows",
    f"""WITH {DEMAND}
    SELECT region, printf('SKU-%06d', sku_n) AS sku, count(*) AS n_holdout FROM demand
    GROUP BY region, sku_n HAVING count(*) FILTER (NOT holdout) = 0""",
)
def keys_without_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that could not be trained: reported, where a single-key trainer would raise."""
    return ModelStore(spark, sf_dir).profile().where("n_train = 0").select(
        "region", train.sku_id(F.col("sku_n")).alias("sku"), "n_holdout"
    )
