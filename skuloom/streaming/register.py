"""Registration of models as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skuloom.operators import registry
from skuloom.session import fresh_path, materialize, state_in_rocks_db
from skuloom.sources import tables

RUNS = "run_id string, parent_id string, layer string, run_name string, experiment string, tags map<string,string>"
LAYOUT = "source string, batch bigint"


def registered(spark: SparkSession, root: str) -> DataFrame:
    """All committed runs. A batch replayed after a crash rewrites its own directory, so nothing counts twice."""
    return spark.read.schema(f"{RUNS}, {LAYOUT}").parquet(root).drop("source", "batch")


def register_batch(root: str, known: str) -> Callable[[DataFrame, int], None]:
    """Runs that the state has not seen before are stored under the query that found them and the number of its batch.

    Only a query's first batch looks at earlier runs: the ids that stood in ``known`` when the query was made, if any did. They go
    into the state with that batch, so no id is read again.
    """

    def register(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        source = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        wanted = batch.where("not seeded").drop("seeded")
        if batch_id == 0 and not (earlier := spark.read.schema("run_id string").parquet(known)).isEmpty():
            # Both joins read the wanted rows: without this copy the batch and its state would be worked out for each.
            wanted = registry.not_registered(materialize(wanted, fresh_path(spark, "wanted")), earlier)
        rows = wanted.withColumns({"source": F.lit(source), "batch": F.lit(batch_id).cast("bigint")})
        writer = rows.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("source", "batch").parquet(root)

    return register


def register_stream(plan: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Register every run-plan row of a stream once: find-or-create by the deterministic run id.

    ``dropDuplicates`` keeps the ids met so far in a state store, spread by id over as many partitions as the session had for
    shuffles when the query began; a micro-batch reads its own rows and nothing stored. A query on a new checkpoint begins with
    the ids that ``root`` holds already, copied once beside its checkpoint and streamed in ahead of everything else.
    A restarted query goes on with its state; a replayed batch overwrites its own directory.
    Back-pressure comes from ``maxFilesPerTrigger`` on the source.
    """
    spark = plan.sparkSession
    known = checkpoint.rstrip("/") + "_known"
    if not tables.path_exists(spark, checkpoint.rstrip("/") + "/offsets"):  # nothing has begun, so a half-written copy is replaced
        earlier = registered(spark, root).select("run_id") if tables.exists(spark, root) else spark.createDataFrame([], "run_id string")
        materialize(earlier.hint("rebalance"), known)
    seeds = spark.readStream.schema("run_id string").parquet(known).withColumn("seeded", F.lit(True))
    arriving = registry.run_rows(plan).withColumn("seeded", F.lit(False))
    once = arriving.unionByName(seeds, allowMissingColumns=True).dropDuplicates(["run_id"])
    writer = once.writeStream.foreachBatch(register_batch(root, known)).option("checkpointLocation", checkpoint)
    with state_in_rocks_db(spark):
        return (writer.trigger(availableNow=True) if available_now else writer).start()

