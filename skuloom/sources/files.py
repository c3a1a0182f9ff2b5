"""Folders through Hadoop's file systems, and what tables say about themselves."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """Text as the inside of a SQL string."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def get_property(spark: SparkSession, name: str, key: str) -> str | None:
    if not spark.catalog.tableExists(name):
        return None
    hits = spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == key).select("value").head(1)
    return hits[0][0] if hits else None


def file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, folder: str) -> bool:
    fs, path = file_system(spark, folder)
    return fs.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = file_system(spark, folder)
    fs.delete(path, True)


def rename(spark: SparkSession, folder: str, to: str) -> None:
    fs, path = file_system(spark, folder)
    if not fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{folder} cannot be renamed to {to}")
