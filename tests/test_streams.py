"""Batches of samples reported while they arrive."""

import random

from skuloom.operators import latency
from skuloom.streaming import latency as streamed

SCHEMA = "seq bigint, region string, ms double, other double"


def rounded(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def reported(spark, source, out):
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    streamed.to_files(streamed.batch_stats(arriving, ["region"], "seq", ["ms", "other"], batch=10), out + "/rows", out + "/at").awaitTermination()
    return rounded(spark.read.parquet(out + "/rows").collect())


def expected(spark, rows):
    df = latency.batch_stats(spark.createDataFrame(rows, SCHEMA), ["region"], "seq", ["ms", "other"], batch=10)
    return rounded(df.collect())


def test_batches_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.random() * 9, None if i % 7 == 0 else rng.random()) for i in range(137)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, upto in enumerate((50, 90, 137)):
        part = rows[(0, 50, 90)[k] : upto]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        assert reported(spark, source, out) == expected(spark, rows[:upto])
