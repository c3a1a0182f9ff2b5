"""Publishing bundles region by region: staged, checked, then named in one manifest.

Under a bundle root every publication writes a folder ``version=<id>`` of its own. What stands is said by the newest complete manifest
(``_manifests/<number>``): one row per region with the folder that holds it. A region whose rows are unfit, whose write fails or
whose files do not hold what was asked keeps the folder it had, and becomes an error row; the other regions are published.
A writer that dies leaves the last manifest in force. Folders that no manifest names any more are removed by :func:`drop_unnamed`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from skuloom.operators import bundle
from skuloom.sources.files import file_system, path_exists, remove

MANIFEST = "region string, folder string, buckets int, rows bigint, skus bigint, bytes bigint"
ERRORS = "region string, stage string, error string"
NO_REGION = "(no region)"
#: What a job of Spark that fails raises.
FAILURES = (PySparkException, Py4JJavaError)


@dataclass(frozen=True)
class Publication:
    manifest: str  # folder of the manifest now in force
    version: str
    regions: list[str]  # published now
    errors: DataFrame


def region_checks(plan: DataFrame) -> DataFrame:
    """Per region: rows, skus, bytes of blobs, and ``error``, which says what makes its rows unfit (null if nothing does).

    Only keys and blob sizes are read; rows meet at their key, not at their region.
    """
    blob = F.col("blob_bytes") if "blob_bytes" in plan.columns else F.octet_length("model_blob_bytes")
    keys = plan.select(F.coalesce("region", F.lit(NO_REGION)).alias("region"), "sku", "model_name", blob.cast("bigint").alias("b"))
    per_key = keys.groupBy("region", "sku", "model_name").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("b", F.lit(0))).alias("bytes"), F.count_if(F.coalesce("b", F.lit(0)) == 0).alias("empty")
    )
    sums = {c: F.sum(c).alias(c) for c in ("rows", "bytes", "empty", "unnamed", "repeated")}
    per_sku = per_key.groupBy("region", "sku").agg(
        F.sum("n").alias("rows"), sums["bytes"], sums["empty"],
        F.sum(F.when(F.col("model_name").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.count_if(F.col("n") > 1).alias("repeated"),
    )
    numbered = F.coalesce(F.col("sku").rlike("^(.*-)?[0-9]{1,18}$"), F.lit(False))
    found = per_sku.groupBy("region").agg(
        *sums.values(), F.count("*").alias("skus"), F.sum(F.when(~numbered, F.col("rows")).otherwise(0)).alias("unnumbered")
    )

    def said(count: str, text: str) -> Column:
        return F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(" " + text)))

    nowhere = F.when(F.col("region") == NO_REGION, F.concat(F.col("rows").cast("string"), F.lit(" rows without region")))
    faults = F.array_compact(
        F.array(
            nowhere,
            said("empty", "rows without a model"),
            said("unnumbered", "rows whose sku ends with no number"),
            said("unnamed", "rows without a model name"),
            said("repeated", "keys that occur more than once"),
        )
    )
    error = F.when(F.size(faults) > 0, F.array_join(faults, "; "))
    return found.select("region", "rows", "skus", "bytes", error.alias("error"))


def publish(plan: DataFrame, root: str, buckets: int) -> Publication:
    """Write the fit regions of ``plan`` in one job, check their files, and name those that hold in a new manifest.

    If the one job fails, every region is written by itself, so that only those at fault stay behind. The driver holds one row per region.
    """
    spark = plan.sparkSession
    root = root.rstrip("/")
    asked, errors = _checked(plan)
    errors += [(name, "check", r["error"]) for name, r in asked.items() if r["error"] is not None]
    fit = sorted(name for name, r in asked.items() if r["error"] is None)
    version = uuid.uuid4().hex[:16]
    staged = f"{root}/version={version}"
    errors += _write(plan, fit, staged, buckets)
    failed = {name for name, _, _ in errors}
    held = _held(spark, staged)
    rows, published = [], []
    for name in (n for n in fit if n not in failed):
        want = (asked[name]["rows"], asked[name]["skus"], asked[name]["bytes"])
        if held.get(name) != want:
            errors.append((name, "verify", f"rows, skus, bytes are {held.get(name)}, asked were {want}"))
            continue
        published.append(name)
        rows.append((name, f"{staged}/{_directory(name)}", buckets, *want))
    kept = [tuple(r) for r in current(spark, root).collect() if r["region"] not in published]
    manifest = _next(spark, root)
    spark.createDataFrame([*kept, *rows], MANIFEST).coalesce(1).write.parquet(manifest)
    return Publication(manifest, version, published, spark.createDataFrame(sorted(errors), ERRORS))


def _checked(plan: DataFrame) -> tuple[dict[str, Row], list[tuple[str, str, str]]]:
    """:func:`region_checks` by region, and an error for every region whose rows cannot even be read."""
    try:
        return {r["region"]: r for r in region_checks(plan).collect()}, []
    except FAILURES:
        names = [r[0] for r in plan.select("region").distinct().collect()]
    asked, errors = {}, []
    for name in names:
        try:
            asked |= {r["region"]: r for r in region_checks(plan.where(F.col("region").eqNullSafe(F.lit(name)))).collect()}
        except FAILURES as e:
            errors.append((name or NO_REGION, "check", _said(e)))
    return asked, errors


def _write(plan: DataFrame, regions: list[str], folder: str, buckets: int) -> list[tuple[str, str, str]]:
    if not regions:
        return []
    try:
        bundle.write_bundle(plan.where(F.col("region").isin(regions)), folder, buckets)
    except FAILURES:
        if path_exists(plan.sparkSession, folder):
            remove(plan.sparkSession, folder)
    else:
        return []
    errors = []
    for name in regions:
        try:
            bundle.write_bundle(plan.where(F.col("region") == name), folder, buckets)
        except FAILURES as e:
            errors.append((name, "write", _said(e)))
    return errors


def _said(e: Exception) -> str:
    """The first line of what went wrong, without the trace around it."""
    cause = getattr(e, "java_exception", None)
    while cause is not None and cause.getCause() is not None:
        cause = cause.getCause()
    return (cause.getMessage() if cause is not None and cause.getMessage() else str(e)).strip().splitlines()[0][:500]


def _held(spark: SparkSession, folder: str) -> dict[str, tuple[int, int, int]]:
    """What the files of a staged version hold, by region."""
    if not path_exists(spark, folder):
        return {}
    rows = bundle.read_bundle(spark, folder).select("region", "sku", F.octet_length("model_blob_bytes").alias("b"))
    per_sku = rows.groupBy("region", "sku").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    found = per_sku.groupBy("region").agg(F.sum("n").alias("rows"), F.count("*").alias("skus"), F.sum("b").alias("bytes"))
    return {r["region"]: (r["rows"], r["skus"], r["bytes"]) for r in found.collect()}


def manifests(spark: SparkSession, root: str) -> list[str]:
    """Complete manifests, the oldest first."""
    folder = f"{root.rstrip('/')}/_manifests"
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    return [f"{folder}/{name}" for name in sorted(s.getPath().getName() for s in fs.listStatus(path)) if path_exists(spark, f"{folder}/{name}/_SUCCESS")]


def _next(spark: SparkSession, root: str) -> str:
    folder = f"{root}/_manifests"
    fs, path = file_system(spark, folder)
    taken = [int(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
    return f"{folder}/{max(taken, default=0) + 1:012d}"


def current(spark: SparkSession, root: str, manifest: str | None = None) -> DataFrame:
    """The manifest in force: (region, folder, buckets, rows, skus, bytes)."""
    found = [manifest] if manifest else manifests(spark, root)[-1:]
    return spark.read.schema(MANIFEST).parquet(found[0]) if found else spark.createDataFrame([], MANIFEST)


def models(spark: SparkSession, root: str, manifest: str | None = None) -> DataFrame:
    """All published models. The manifest is read once, here: what is published later does not change this DataFrame."""
    folders = [r["folder"] for r in current(spark, root, manifest).select("folder").collect()]
    if not folders:
        return spark.createDataFrame([], bundle.BUNDLE_SCHEMA)
    schema = bundle.BUNDLE_SCHEMA + ", version string"
    return spark.read.schema(schema).option("basePath", root.rstrip("/")).parquet(*folders).drop("version")


def drop_unnamed(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove the manifests before the newest and the ``keep`` before it, and the versions that none of the rest names; call it when nobody publishes."""
    root = root.rstrip("/")
    every = manifests(spark, root)
    stand = every[-1 - keep :]
    named = {r["folder"].rsplit("/", 1)[0].rsplit("/", 1)[-1] for m in stand for r in current(spark, root, m).select("folder").collect()}
    for m in every[: -1 - keep]:
        remove(spark, m)
    fs, path = file_system(spark, root)
    gone = [n for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("version=") and n not in named]
    for name in gone:
        remove(spark, f"{root}/{name}")
    return len(gone)


def _directory(region: str) -> str:
    """The directory that Spark writes for a region."""
    escaped = "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 0x20 or ord(c) == 0x7F else c for c in region)
    return f"region={escaped}"


#: Characters that Spark escapes in partition directories.
_ESCAPED = set("\"#%'*/:=?\\{[]^")
