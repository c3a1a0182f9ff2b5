"""Session helpers: the shared working folder and materialised intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="skuloom-"))
    return sc.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared folder that belongs to this application."""
    return "/".join([shared_folder(spark), "skuloom", spark.sparkContext.applicationId, *parts])


def fresh_path(spark: SparkSession, name: str) -> str:
    return work_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def source_tag(sf_dir: str) -> str:
    return hashlib.md5(sf_dir.encode()).hexdigest()[:10]


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# A micro-batch adds its own changes to the checkpoint, not the files of the whole state that it rewrote.
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


@contextmanager
def state_in_rocks_db(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on the executors' disks and in the checkpoint, not in heaps.

    A query keeps the provider it began with.
    """
    wanted = {STATE_PROVIDER: ROCKS_DB, CHANGELOG: "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
