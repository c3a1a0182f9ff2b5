"""Reading and writing tables by name or path, and looking after their definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.session import fresh_path, materialize
from skuloom.sources import snapshots
from skuloom.sources.files import get_property, path_exists, quoted, remove


def is_table_name(target: str) -> bool:
    return "." in target and "/" not in target


def read_any(spark: SparkSession, target: str) -> DataFrame:
    if is_table_name(target):
        return spark.read.table(target)
    if not path_exists(spark, target):
        snapshots.recover(spark, target)
    return spark.read.parquet(target)


def write_any(df: DataFrame, target: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("overwriteSchema", "true").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(target) if is_table_name(target) else writer.parquet(target)


def append_any(df: DataFrame, target: str, partition_by: list[str] | None = None) -> None:
    """Add rows to a stored table; they may be computed from it, as its present files are listed first."""
    if is_table_name(target):
        df.select(*df.sparkSession.read.table(target).columns).write.insertInto(target)
        return
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key for the write; adaptive execution splits partitions a hot key makes too big."""
    return df.hint("rebalance", *keys)


def persist_run_plan(plan: DataFrame, target: str, clustered: bool = False) -> None:
    """``clustered`` says that the rows of a key lie together already, as training leaves them: they are written where they are."""
    write_any(plan if clustered else spread_by(plan, "region", "sku"), target)


def persist_demand(demand: DataFrame, target: str) -> None:
    """Partitioned by region. Spread by region alone, so that a task writes one directory; big regions are split."""
    write_any(spread_by(demand, "region"), target, partition_by=["region"])


def exists(spark: SparkSession, target: str) -> bool:
    if is_table_name(target):
        return spark.catalog.tableExists(target)
    try:
        spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def stored_or_built(spark: SparkSession, target: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``target`` if it is there, otherwise build and store it first."""
    if not exists(spark, target):
        write_any(build(), target)
    return read_any(spark, target)


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}" + (f" LOCATION '{location}'" if location else ""))


def comment_table(spark: SparkSession, name: str, text: str) -> None:
    spark.sql(f"COMMENT ON TABLE {name} IS '{quoted(text)}'")


def comment_columns(spark: SparkSession, name: str, comments: dict[str, str]) -> None:
    for column, text in comments.items():
        spark.sql(f"ALTER TABLE {name} ALTER COLUMN {column} COMMENT '{quoted(text)}'")


def set_property(spark: SparkSession, name: str, key: str, value: str) -> None:
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{key}' = '{quoted(value)}')")


def ensure_table(spark: SparkSession, name: str, ddl: str, partition_by: list[str], comment: str = "") -> bool:
    """Create an empty table, whose rows are replaced without a gap, unless one of that name exists; that is left as it is."""
    return snapshots.create(spark, name, ddl, partition_by, comment)


def replace_rows(df: DataFrame, name: str) -> None:
    """Swap all rows of a table, keeping its columns, comments and properties; ``df`` may be computed from the table.

    A table made by :func:`ensure_table` switches to the new rows at once. Into any other one they are inserted from a staged copy: a
    computation that fails leaves it as it was, readers may meet the insert half-way.
    """
    spark = df.sparkSession
    if snapshots.is_snapshot(spark, name):
        snapshots.replace(df, name)
        return
    staging = fresh_path(spark, "staging")
    staged = materialize(df.select(*spark.read.table(name).columns), staging)
    staged.write.insertInto(name, overwrite=True)
    remove(spark, staging)


def replace_from_itself(df: DataFrame, target: str, partition_by: list[str] | None = None) -> None:
    """Overwrite ``target`` with a result computed from it: the whole result is written before the old rows go."""
    if is_table_name(target):
        return replace_rows(df, target)
    return snapshots.replace_folder(df, target, partition_by)


def append_outcome(outcome: DataFrame, target: str) -> None:
    """Append a run outcome as one JSON payload row."""
    payload = outcome.select(F.to_json(F.struct("*")).alias("payload"))
    write_any(payload, target, mode="append")
