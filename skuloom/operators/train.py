"""Train and evaluate the built-in models of every (region, sku) as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.functions.skew import ROWS_PER_TASK, skew_join
from skuloom.functions.skus import sku_id, sku_number

MODEL_NAMES = ["mean", "price_ols", "weekday_mean"]
METRIC_NAMES = ["rmse", "mape", "r2", "mae", "mse", "accuracy", "precision", "recall", "f1"]
# Fixed values of our metric definitions.
HIT_TOLERANCE = 0.25
HIGH_DEMAND = 25
# Predictions carry six decimals, and errors are summed as decimals: metrics do not depend on the order of rows.
PREDICTION_DIGITS = 6
ERROR_TYPE, SHARE_TYPE = "decimal(30,8)", "decimal(30,12)"

# Columns that tell rows of a key apart, used where present to spread a hot key.
ROW_MARKS = ["row_no", "order_no", "date"]
REFERENCE_BYTES = 64 * 1024 * 1024

BLOB_SCHEMA = "kind string, mean double, intercept double, slope double, weekday array<double>"


def narrow(demand: DataFrame) -> DataFrame:
    """The columns that training and evaluation read."""
    marks = [c for c in ROW_MARKS if c in demand.columns][:1]  # one tells a hot key's rows apart well enough
    return demand.select("region", "sku_n", "demand", "price", "day_of_week", "holdout", *marks)


def profile(demand: DataFrame) -> DataFrame:
    """One row per (region, sku) with all sums the built-in models need; training rows are those not held out.

    One pass, combined before the shuffle, so the busiest key costs one row per map task.
    """
    train = ~F.col("holdout")
    y = F.when(train, F.col("demand").cast("double"))
    x = F.when(train & F.col("demand").isNotNull(), F.col("price"))
    on_day = [train & (F.col("day_of_week") == d) for d in range(7)]
    return demand.groupBy("region", "sku_n").agg(
        F.count(y).alias("n_train"),
        F.count_if(F.col("holdout")).alias("n_holdout"),
        F.sum(y).alias("sum_y"),
        F.min(x).alias("min_price"),
        F.max(x).alias("max_price"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        *[F.sum(F.when(c, F.col("demand").cast("double"))).alias(f"sum_{d}") for d, c in enumerate(on_day)],
        *[F.count(F.when(c, F.col("demand"))).alias(f"n_{d}") for d, c in enumerate(on_day)],
    )


def coefficients(profiles: DataFrame) -> DataFrame:
    """Model coefficients of every key that has training rows."""
    mean = F.col("sum_y") / F.col("n_train")
    # NULL prices leave slope, min and max NULL, and the comparison falls through to the mean.
    sloped = F.col("min_price") < F.col("max_price")
    return profiles.where(F.col("n_train") > 0).select(
        "region",
        "sku_n",
        "n_train",
        "n_holdout",
        mean.alias("mean"),
        F.when(sloped, F.col("intercept")).otherwise(mean).alias("intercept"),
        F.when(sloped, F.col("slope")).otherwise(F.lit(0.0)).alias("slope"),
        F.array(*[F.coalesce(F.try_divide(F.col(f"sum_{d}"), F.col(f"n_{d}")), mean) for d in range(7)]).alias("weekday"),
    )


def predictions(mean: Column, intercept: Column, slope: Column, weekday: Column) -> dict[str, Column]:
    """Prediction of each model for a row with ``price`` and ``day_of_week``."""
    raw = {
        "mean": mean,
        "price_ols": F.coalesce(intercept + slope * F.col("price"), mean),
        "weekday_mean": F.coalesce(F.get(weekday, F.col("day_of_week")), mean),
    }
    return {m: F.round(p, PREDICTION_DIGITS) for m, p in raw.items()}


def exact_sum(value: Column, kind: str = ERROR_TYPE) -> Column:
    """Sum that is the same in any order of rows."""
    return F.sum(value.cast(kind)).cast("double")


def evaluate(demand: DataFrame, coefs: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Holdout metrics per (region, sku): one struct of metrics per model, sums combined before the shuffle."""
    needed = ["demand", "price", "day_of_week"]
    spread = [*needed, *[c for c in ROW_MARKS if c in demand.columns]]
    holdout = demand.where("holdout").select("region", "sku_n", *spread)
    joined = skew_join(holdout, coefs, ["region", "sku_n"], "n_holdout", spread, rows_per_task)
    guesses = predictions(F.col("mean"), F.col("intercept"), F.col("slope"), F.col("weekday"))
    rows = joined.select(
        "region", "sku_n", F.col("demand").cast("double").alias("y"), *[g.alias(f"p_{m}") for m, g in guesses.items()]
    )
    y = F.col("y")
    # The central moment: sum(y * y) - sum(y)^2 / n would cancel where demand is large.
    sums = [F.count(y).alias("n"), (F.var_pop(y) * F.count(y)).alias("spread"), (F.min(y) < F.max(y)).alias("varied")]
    for m in MODEL_NAMES:
        p = F.col(f"p_{m}")
        off = F.abs(y - p)
        share = F.try_divide(off, y)
        high, called = y > HIGH_DEMAND, p > HIGH_DEMAND
        sums += [
            exact_sum(off * off).alias(f"sse_{m}"),
            exact_sum(off).alias(f"sae_{m}"),
            (exact_sum(share, SHARE_TYPE) / F.count(share)).alias(f"mape_{m}"),
            F.count_if(share <= HIT_TOLERANCE).alias(f"hit_{m}"),
            F.count_if(high & called).alias(f"tp_{m}"),
            F.count_if(~high & called).alias(f"fp_{m}"),
            F.count_if(high & ~called).alias(f"fn_{m}"),
        ]
    n = F.col("n")

    def metrics(m: str) -> Column:
        sse, tp = F.col(f"sse_{m}"), F.col(f"tp_{m}")
        fp, fn = F.col(f"fp_{m}"), F.col(f"fn_{m}")
        values = {
            "rmse": F.sqrt(sse / n),
            "mape": F.col(f"mape_{m}"),
            "r2": F.when(F.col("varied"), 1 - F.try_divide(sse, F.col("spread"))),
            "mae": F.col(f"sae_{m}") / n,
            "mse": sse / n,
            "accuracy": F.col(f"hit_{m}") / n,
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
        return F.struct(*[values[k].cast("double").alias(k) for k in METRIC_NAMES])

    return rows.groupBy("region", "sku_n").agg(*sums).select(
        "region", "sku_n", *[metrics(m).alias(f"m_{m}") for m in MODEL_NAMES]
    )


def _text(value: Column) -> Column:
    return value.cast("string")


def run_plan(coefs: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Run-plan rows: key, serialised model, settings and metrics; metrics that are undefined have no map entry.

    The metrics come distributed by key; the coefficients, one row per key, are shuffled to them where they were stored.
    """
    def row(m: str) -> Column:
        keep_line, keep_days = m == "price_ols", m == "weekday_mean"
        blob = F.to_json(
            F.struct(
                F.lit(m).alias("kind"),
                F.col("mean"),
                *([F.col("intercept"), F.col("slope")] if keep_line else []),
                *([F.col("weekday")] if keep_days else []),
            )
        ).cast("binary")
        params = {
            "model_type": F.lit(m),
            "features_count": F.lit({"mean": "0", "price_ols": "1", "weekday_mean": "1"}[m]),
            "target_metric": F.lit("demand"),
            "n_train": _text(F.col("n_train")),
            "n_holdout": _text(F.col("n_holdout")),
        }
        if keep_line:
            params |= {"intercept": _text(F.col("intercept")), "slope": _text(F.col("slope"))}
        found = F.col(f"m_{m}")
        metrics = F.map_filter(
            F.map_from_arrays(
                F.array(*[F.lit(k) for k in METRIC_NAMES]), F.array(*[found[k] for k in METRIC_NAMES])
            ),
            lambda _, v: v.isNotNull(),
        )
        pairs = [c for k, v in params.items() for c in (F.lit(k), v)]
        return F.struct(
            F.lit(m).alias("model_name"),
            blob.alias("model_blob_bytes"),
            F.octet_length(blob).alias("blob_bytes"),
            F.create_map(*pairs).alias("params"),
            metrics.alias("metrics"),
        )

    return coefs.join(evaluated, ["region", "sku_n"], "left").select(
        "region", sku_id(F.col("sku_n")).alias("sku"), F.inline(F.array(*[row(m) for m in MODEL_NAMES]))
    )


def evaluation_long(plan: DataFrame) -> DataFrame:
    """One row per model with each metric as a column; undefined metrics are NULL."""
    return plan.select("region", "sku", "model_name", *[F.col("metrics")[k].alias(k) for k in METRIC_NAMES])


def decoded(blob: Column) -> Column:
    """Coefficients of a built-in model out of its stored bytes."""
    return F.from_json(blob.cast("string"), BLOB_SCHEMA)


def predict(model: Column) -> Column:
    """Prediction of a decoded model for a row with ``price`` and ``day_of_week``, without leaving the JVM."""
    guesses = predictions(model["mean"], model["intercept"], model["slope"], model["weekday"])
    out = guesses["mean"]
    for kind in ("price_ols", "weekday_mean"):
        out = F.when(model["kind"] == kind, guesses[kind]).otherwise(out)
    return out


def attach_reference(
    keys: DataFrame, models: DataFrame, blob: str = "model_blob_bytes", broadcast_bytes: int = REFERENCE_BYTES
) -> DataFrame:
    """Give every run-plan key the stored model of its name: ``models`` has one row per model name.

    The models are broadcast when their measured size allows. Larger ones are shuffled, each copied once per
    shuffle partition and the keys spread over the copies, since there are only a few names to shuffle by.
    """
    size = models.agg(F.coalesce(F.sum(F.octet_length(blob)), F.lit(0))).first()[0]
    given = models.select("model_name", blob)
    if size <= broadcast_bytes:
        return keys.join(F.broadcast(given), "model_name")
    copies = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = keys.withColumn("__copy", F.pmod(F.xxhash64("region", "sku"), F.lit(copies)).cast("int"))
    copied = given.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return spread.join(copied.hint("shuffle_hash"), ["model_name", "__copy"]).drop("__copy")


def slice_of(demand: DataFrame, region: str, sku: str) -> DataFrame:
    """Rows of one key; the numeric id is named too, where there is one, since that filter reaches the scan."""
    rows = demand.where((F.col("region") == region) & (F.col("sku") == sku))
    return rows.where(F.col("sku_n") == int(sku.split("-")[-1])) if "sku_n" in demand.columns else rows


def prepared(demand: DataFrame, holdout_share: int = 5) -> DataFrame:
    """Add to a plain demand table what training needs: the numeric sku, and every fifth row or so held out by hash."""
    return demand.withColumn("sku_n", sku_number("sku")).withColumn(
        "holdout", F.pmod(F.xxhash64("sku", "date", "product_id", "price", "inventory"), F.lit(holdout_share)) == 0
    )


def reference_models(demand: DataFrame, region: str, sku: str) -> DataFrame:
    """(model_name, model_blob_bytes) trained on one key; a key without rows is an error."""
    rows = slice_of(demand, region, sku).withColumn("holdout", F.lit(False))
    if rows.isEmpty():
        raise ValueError(f"no demand rows for region {region}, sku {sku}")
    coefs = coefficients(profile(rows))
    return run_plan(coefs, evaluate(rows, coefs)).select("model_name", "model_blob_bytes")


def features(demand: DataFrame) -> DataFrame:
    """Model inputs and target as doubles, in fixed order."""
    columns = ["price", "day_of_week", "promotion", "inventory", "demand"]
    return demand.select(
        "region",
        "sku",
        *[(F.col(c).cast("int") if c == "promotion" else F.col(c)).cast("double").alias(c) for c in columns],
    )
