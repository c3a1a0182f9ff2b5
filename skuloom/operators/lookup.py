"""Finding models in a bundle and scoring requests with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.functions import skus as S
from skuloom.functions.skew import BROADCAST_ROWS, ROWS_PER_TASK, broadcast_if, chunked
from skuloom.operators import questions, train


def with_bucket(requests: DataFrame, buckets: int) -> DataFrame:
    """Add what a lookup needs: the numeric sku, and the bucket, which no filter on sku would imply."""
    return requests.withColumn("sku_n", S.sku_number("sku")).withColumn("bucket", S.sku_bucket("sku", buckets))


def lookup_one(models: DataFrame, region: str, sku: str, buckets: int, model_name: str | None = None) -> DataFrame:
    """Rows of one sku: prunes to one bucket directory and, by sku range, to its row groups."""
    number = int(sku.split("-")[-1])
    found = models.where(
        (F.col("region") == region) & (F.col("bucket") == number % buckets) & (F.col("sku_n") == number) & (F.col("sku") == sku)
    )
    return found if model_name is None else found.where(F.col("model_name") == model_name)


def named(requests: DataFrame, chosen: DataFrame) -> DataFrame:
    """Give each request the model to use for its (region, sku); requests without one keep NULL."""
    return requests.join(chosen.select("region", "sku", "model_name"), ["region", "sku"], "left")


def unmatched(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requests whose (region, sku) has no model: reported as rows, the batch goes on."""
    return requests.join(models.select("region", "sku").distinct(), ["region", "sku"], "left_anti")


def serving(models: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen model of each (region, sku), decoded once: store it where it is used again and again."""
    picked = models.join(chosen.select("region", "sku", "model_name"), ["region", "sku", "model_name"])
    return picked.select("region", "sku", "model_name", train.decoded(F.col("model_blob_bytes")).alias("model"))


def score(requests: DataFrame, served: DataFrame, counts: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Predict every request with the model served for its (region, sku); see :func:`serving`.

    In a batch, adaptive skew handling splits a hot sku's requests. Where that does not run (streams), ``counts`` (region, sku,
    rows), stored from earlier requests, says which keys are hot: their models alone are copied, once per task they need.
    """
    keys = ["region", "sku"]
    if counts is not None:
        copies = F.ceil(F.col("rows") / F.lit(rows_per_task)).cast("int")
        hot = counts.where(F.col("rows") > rows_per_task).select(*keys, copies.alias("__copies"))
        hot = broadcast_if(hot.count() <= BROADCAST_ROWS)(hot)
        one = F.coalesce("__copies", F.lit(1))
        spread = F.pmod(F.xxhash64(*requests.columns), one).cast("int")
        requests = requests.join(hot, keys, "left").withColumn("__copy", spread).drop("__copies")
        served = served.join(hot, keys, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), one - 1))).drop("__copies")
        keys = [*keys, "__copy"]
    scored = requests.join(served, keys).withColumn("prediction", train.predict(F.col("model")))
    return scored.drop("model", "__copy")


def score_opaque(
    requests: DataFrame,
    models: DataFrame,
    load: Callable[[bytes], object],
    apply: Callable[[object, np.ndarray], np.ndarray],
    features: list[str],
    blob: str = "model_blob_bytes",
    rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Score with models only Python can decode; ``models`` has one row per (region, sku, model_name).

    A blob is never joined onto its requests. Model rows and request rows are shuffled together by key and sorted so
    that a model comes just before its requests: it travels and is decoded once per task that needs it.
    A key with very many requests is split over several tasks, and its model row goes to each of them. Spark cuts the batches
    that a task gets by ``spark.sql.execution.arrow.maxBytesPerBatch``, so large blobs come a few at a time.
    ``counts`` (region, sku, model_name, rows) saves counting the requests per key when that is known already.
    """
    keys, spread = ["region", "sku", "model_name"], [c for c in requests.columns]
    if counts is None:
        counts = requests.groupBy(*keys).agg(F.count("*").alias("rows"))
    counts = counts.select(*keys, F.col("rows").alias("__rows")).where("__rows > 0")
    asked = chunked(requests, counts, keys, "__rows", spread, rows_per_task).drop("n_chunks")
    pieces = F.ceil(F.col("__rows") / F.lit(rows_per_task)).cast("int")
    given = models.select(*keys, blob).join(counts, keys).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), pieces - 1))
    )
    rest = [c for c in requests.columns if c not in keys]
    rows = given.select(
        *keys, "chunk", F.lit(0).alias("__turn"), blob, *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in rest]
    ).unionByName(
        asked.select(*keys, "chunk", F.lit(1).alias("__turn"), F.lit(None).cast("binary").alias(blob), *rest)
    )
    # A number of partitions counted from the rows: adaptive splitting could part a model from its requests.
    total = counts.agg(F.sum("__rows")).first()[0] or 0
    tasks = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_task))
    # One number comes first in the order: it decides nearly every comparison, also those between neighbours below.
    marks = ["__spot", *keys, "chunk"]
    spot = rows.withColumn("__spot", F.xxhash64(*keys, "chunk"))
    ordered = spot.repartition(tasks, *keys, "chunk").sortWithinPartitions(*marks, "__turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, model = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for c in [*marks, "__turn"]:
                column = batch.column(c)
                new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
                nulls = pc.is_null(column).to_numpy(zero_copy_only=False)
                new[1:] |= nulls[1:] != nulls[:-1]
            starts = np.flatnonzero(new)
            heads = [batch.column(c).take(pa.array(starts)).to_pylist() for c in [*marks, "__turn", blob]]
            x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features])
            predicted, scored = np.empty(n), np.zeros(n, dtype=bool)
            for first, last, *key, turn, data in zip(starts.tolist(), [*starts[1:].tolist(), n], *heads, strict=True):
                if turn == 0:
                    current, model = key, load(data)
                elif key == current:
                    predicted[first:last] = apply(model, x[first:last])
                    scored[first:last] = True
            kept = pa.array(scored)
            out = [batch.column(c).filter(kept) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(predicted[scored])], [*columns, "prediction"])

    columns = [*keys, *rest]
    fields = [requests.schema[c] for c in columns]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("prediction", T.DoubleType())])
    return ordered.mapInArrow(run, schema)


def lookup_many(models: DataFrame, requests: DataFrame, buckets: int) -> DataFrame:
    """All models of the requested skus: the distinct keys joined with the bundle.

    The bucket is part of the key, so few requests prune the bundle to their directories, and many share one shuffle.
    """
    keys = with_bucket(requests.select("region", "sku").distinct(), buckets)
    return models.join(keys, ["region", "bucket", "sku_n", "sku"])


def score_from_bundle(requests: DataFrame, models: DataFrame, buckets: int) -> DataFrame:
    """Predict (region, sku) requests straight from the bundle, each by the best evaluated model of its key.

    The model is chosen from narrow columns; blobs are then shuffled once, without the maps beside them.
    """
    place = ["region", "bucket", "sku_n", "sku"]
    narrow = models.select(*place, "model_name", *[F.col("metrics")[m].alias(m) for m in ("rmse", "mape")])
    chosen = questions.default_models(lookup_many(narrow, requests, buckets))
    return score(requests, serving(models.select("region", "sku", "model_name", "model_blob_bytes"), chosen))


def sample_skus(skus: DataFrame, n: int, seed: int) -> DataFrame:
    """Seeded sample of ``n`` skus: the smallest digests, the same on any layout."""
    return skus.select("sku").distinct().orderBy(F.md5(F.concat_ws("/", "sku", F.lit(str(seed)))), "sku").limit(n)


def lookup_sample(skus: DataFrame, seed: int = 42, cold: int = 100, warm: int = 10, repeats: int = 10) -> DataFrame:
    """Skus looked up once each (cold) and a few looked up again and again (warm)."""
    once = sample_skus(skus, cold, seed).select(F.lit("cold").alias("path"), "sku", F.lit(0).alias("round"))
    again = sample_skus(skus, warm, seed + 1).select(
        F.lit("warm").alias("path"), "sku", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("round")
    )
    return once.unionByName(again)
