"""Tables and folders whose rows change by a switch to a new version: readers see all old rows or all new ones.

A snapshot table is an external table that points to one folder of versions. New rows are written to a folder of their own
and counted there; then one change of the table's location makes them the table's rows, for SQL and DataFrames alike. A writer that dies before
that leaves the table as it was, and its folder to :func:`drop_old_versions`. Queries under way go on reading the version they began with.

Partitions of such a table are found by listing its folder, not in the catalog, so that the location alone decides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.sources.files import file_system, get_property, path_exists, quoted, remove, rename

ROOT_PROPERTY = "snapshot_root"
LISTED_PARTITIONS = "spark.sql.hive.manageFilesourcePartitions"


def create(spark: SparkSession, name: str, ddl: str, partition_by: list[str], comment: str = "", root: str | None = None) -> bool:
    """Create an empty snapshot table unless a table of that name exists. ``root`` holds its versions."""
    if spark.catalog.tableExists(name):
        return False
    if root is None:
        root = f"{_schema_location(spark, name)}/{name.split('.')[-1]}_versions"
    before = spark.conf.get(LISTED_PARTITIONS)
    spark.conf.set(LISTED_PARTITIONS, "false")  # the table remembers it
    try:
        parts = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        spark.sql(
            f"CREATE TABLE {name} ({ddl}) USING parquet {parts} LOCATION '{quoted(_fresh(root))}' "
            f"COMMENT '{quoted(comment)}' TBLPROPERTIES ('{ROOT_PROPERTY}' = '{quoted(root)}')"
        )
    finally:
        spark.conf.set(LISTED_PARTITIONS, before)
    return True


def is_snapshot(spark: SparkSession, name: str) -> bool:
    return get_property(spark, name, ROOT_PROPERTY) is not None


def stage(df: DataFrame, name: str) -> str:
    """Write ``df`` as a new version that nobody reads yet; returns its folder."""
    spark = df.sparkSession
    table = spark.read.table(name)
    folder = _fresh(get_property(spark, name, ROOT_PROPERTY))
    types = {f.name: f.dataType for f in table.schema}
    rows = df.select(*[F.col(c).cast(types[c]).alias(c) for c in table.columns])
    parts = _partition_columns(spark, name)
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*parts) if parts else writer).parquet(folder)
    return folder


def switch(spark: SparkSession, name: str, folder: str) -> None:
    """Make a staged version the table's rows. A version whose writer did not end is refused."""
    if not path_exists(spark, folder + "/_SUCCESS"):
        raise ValueError(f"{folder} is not complete")
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{quoted(folder)}'")
    spark.catalog.refreshTable(name)


def replace(df: DataFrame, name: str) -> str:
    """Swap all rows; ``df`` may be computed from the table. Columns, comments and properties stay."""
    folder = stage(df, name)
    switch(df.sparkSession, name, folder)
    return folder


def location(spark: SparkSession, name: str) -> str:
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    return row["data_type"].rstrip("/")


def versions(spark: SparkSession, name: str) -> list[str]:
    """Folders of all versions, the oldest first."""
    return [folder for _, folder in _listed(spark, get_property(spark, name, ROOT_PROPERTY))]


def drop_old_versions(spark: SparkSession, name: str, keep: int = 1) -> int:
    """Delete all but the current version and the ``keep`` newest of those before it; returns how many went.

    Versions written later than the current one may belong to a writer at work and stay: call it when none is.
    """
    current = location(spark, name).split("/")[-1]
    found = _listed(spark, get_property(spark, name, ROOT_PROPERTY))
    names = [folder.split("/")[-1] for _, folder in found]
    older = [folder for _, folder in found[: names.index(current)]] if current in names else []
    gone = older[: max(0, len(older) - keep)]
    for folder in gone:
        remove(spark, folder)
    return len(gone)


def replace_folder(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Swap all rows of a Parquet folder; ``df`` may be computed from it. See :func:`recover`."""
    spark = df.sparkSession
    path = path.rstrip("/")
    recover(spark, path)
    after, before = path + "__next", path + "__before"
    remove(spark, after)
    df.write.partitionBy(*partition_by or []).parquet(after)
    remove(spark, before)
    rename(spark, path, before)
    rename(spark, after, path)
    remove(spark, before)


def recover(spark: SparkSession, path: str) -> bool:
    """Finish a swap whose writer died between its two renames: the new rows, complete by then, take their place."""
    path = path.rstrip("/")
    if path_exists(spark, path) or not path_exists(spark, path + "__next/_SUCCESS"):
        return False
    rename(spark, path + "__next", path)
    return True


def _fresh(root: str) -> str:
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex[:16]}"


def _schema_location(spark: SparkSession, name: str) -> str:
    schema = name.rsplit(".", 1)[0] if "." in name else spark.catalog.currentDatabase()
    return spark.catalog.getDatabase(schema).locationUri.rstrip("/")


def _partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def _listed(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, path = file_system(spark, root)
    if not fs.exists(path):
        return []
    return sorted((s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(path) if s.isDirectory())
