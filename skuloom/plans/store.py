"""Stored artefacts of one source folder, built once per application in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.functions.skus import bucket_count
from skuloom.operators import bundle, lookup, questions, shelf
from skuloom.plans import registration
from skuloom.session import materialize, source_tag, work_path
from skuloom.sources import demand as D
from skuloom.sources import tables

# The tables that demand is made of.
SOURCES = ["region", "nation", "customer", "orders", "lineitem", "part"]
_built: dict[tuple[str, str, str], str] = {}


class ModelStore:
    """Run plan, bundle and row-group index of the demand in ``sf_dir``; each is written on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self.state = self._state()

    def _state(self) -> str:
        """Names, sizes and times of the source files: when one changes, everything is built anew."""
        found = []
        for table in SOURCES:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{table}.parquet")
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            found += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(path)]
        return source_tag("\n".join(sorted(found)))

    def _stored(self, name: str, build: Callable[[str], None]) -> str:
        key = (self.spark.sparkContext.applicationId, self.state, name)
        if key not in _built:
            path = work_path(self.spark, self.state, name)
            build(path)
            _built[key] = path
        return _built[key]

    def demand(self, inventory: bool = True) -> DataFrame:
        return D.demand(self.spark, self.sf_dir, inventory)

    def plan(self) -> DataFrame:
        def build(path: str) -> None:
            plan = registration.train_plan(self.demand(inventory=False), path + "_profile")
            tables.persist_run_plan(plan, path, clustered=True)

        return self.spark.read.parquet(self._stored("plan", build))

    def telemetry(self) -> DataFrame:
        return registration.telemetry(self.plan()).drop("logged_at")

    def served(self) -> DataFrame:
        chosen = questions.default_models(self.telemetry())
        path = self._stored("served", lambda path: materialize(lookup.serving(self.plan(), chosen), path))
        return self.spark.read.parquet(path)

    def profile(self) -> DataFrame:
        self.plan()
        return self.spark.read.parquet(self._stored("plan", lambda _: None) + "_profile")

    def buckets(self) -> int:
        return bucket_count(self.plan().agg(F.count_distinct("sku")).first()[0])

    def plan_path(self) -> tuple[str, T.StructType]:
        schema = self.plan().schema
        return self._stored("plan", lambda _: None), schema

    def bundle_root(self) -> str:
        plan = self.plan()
        return self._stored("bundle", lambda path: bundle.write_bundle(plan, path, self.buckets()))

    def shelf(self) -> str:
        """Name of the bucketed table of the models."""
        name = f"shelf_{self.state}_{self.spark.sparkContext.applicationId}".replace("-", "_")

        def build(path: str) -> None:
            total = self.plan().agg(F.sum(bundle.row_bytes(self.plan()))).first()[0] or 0
            shelf.put(self.plan(), name, path, shelf.shelf_buckets(total, self.spark.sparkContext.defaultParallelism))

        self._stored("shelf", build)
        return name

    def bundle(self) -> DataFrame:
        return bundle.read_bundle(self.spark, self.bundle_root())
