"""Status of runs as an append-only log of events, folded into a current state range by range of their ids.

An event says that a run had a status at a time. Writers only append; the latest event of a run, by its time, then its number, then the
event's other values, is its status, so repeated, late and out-of-order events change nothing that a later one has said.
:func:`compact` folds the events written since into the state: the state is cut into ranges of hashed ids, and only ranges
that have new events are read and written again. Both are found through one small record of what stands.

An append is written where its rows lie, without a shuffle. A compaction shuffles once: events come to their piece of a range,
where they are folded and written; ids of 32 hex digits travel as 16 bytes. The state alone is read without a shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.sources.files import file_system, path_exists, remove

EVENTS = "run_id string, region string, status string, error string, at timestamp, seq bigint"
RANGES = 64
FINISHED, FAILED, RUNNING = "FINISHED", "FAILED", "RUNNING"


def _range(run_id: str = "run_id") -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(RANGES)).cast("int").alias("range")


def append(events: DataFrame, log: str) -> None:
    """Add events (see ``EVENTS``), each append a folder of its own; a repeated append is a repeated event, which changes nothing."""
    folder = f"{log}/events/part={uuid.uuid4().hex[:16]}"
    rows = events.select(*[F.col(c.split()[0]) for c in EVENTS.split(", ")])
    rows.write.option("compression", "zstd").parquet(folder)


def _packed(events: DataFrame) -> DataFrame:
    """Events with a run id, which stands as bytes in ``id``: a zero and 16 bytes if it is 32 hex digits, else a one and its text."""
    hex_digits = F.col("run_id").rlike("^[0-9a-f]{32}\\z")
    short = F.concat(F.unhex(F.lit("00")), F.unhex(F.when(hex_digits, F.col("run_id"))))
    packed = F.coalesce(short, F.concat(F.unhex(F.lit("01")), F.encode("run_id", "UTF-8")))
    return events.where("run_id is not null").withColumn("id", packed).drop("run_id")


def _unpacked(events: DataFrame, *more: str) -> DataFrame:
    tail = F.substring("id", 2, 2**31 - 1)
    run_id = F.when(F.substring("id", 1, 1) == F.unhex(F.lit("00")), F.lower(F.hex(tail))).otherwise(F.decode(tail, "UTF-8"))
    return events.withColumn("run_id", run_id).drop("id").select(*[c.split()[0] for c in EVENTS.split(", ")], *more)


def _newest() -> Column:
    """All that an event says is what it is ordered by, so the greatest is the event itself."""
    return F.max(F.struct("at", "seq", "status", "error", "region")).alias("e")


def latest(events: DataFrame) -> DataFrame:
    """One row per run: its latest event. Events without a run id say nothing."""
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return events.where("run_id is not null").groupBy("run_id").agg(_newest()).select("run_id", "e.*").select(*names)


def _folded(events: DataFrame) -> DataFrame:
    """:func:`latest` with the range of each run, runs of a range together in a few tasks, about as many in all as the session shuffles to."""
    pieces = -(-int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")) // RANGES)
    piece = F.pmod(F.floor(F.xxhash64("run_id") / F.lit(RANGES)), F.lit(pieces)).cast("int").alias("piece")
    placed = _packed(events.select("*", _range(), piece)).repartition("range", "piece")
    newest = placed.groupBy("range", "piece", "id").agg(_newest()).select("range", "id", "e.*")
    return _unpacked(newest, "range")


def _parts(spark: SparkSession, log: str) -> list[str]:
    """Complete appends."""
    fs, path = file_system(spark, f"{log}/events")
    if not fs.exists(path):
        return []
    found = sorted(s.getPath().getName() for s in fs.listStatus(path))
    return [n for n in found if path_exists(spark, f"{log}/events/{n}/_SUCCESS")]


def _states(spark: SparkSession, log: str) -> list[str]:
    fs, path = file_system(spark, f"{log}/states")
    if not fs.exists(path):
        return []
    found = sorted(s.getPath().getName() for s in fs.listStatus(path))
    return [f"{log}/states/{n}" for n in found if path_exists(spark, f"{log}/states/{n}/_SUCCESS")]


def _stands(spark: SparkSession, log: str) -> tuple[dict[int, str], set[str]]:
    """(folder of each range of the state, appends that the state holds)."""
    states = _states(spark, log)
    if not states:
        return {}, set()
    rows = spark.read.schema("kind string, range int, name string").parquet(states[-1]).collect()
    return {r["range"]: r["name"] for r in rows if r["kind"] == "range"}, {r["name"] for r in rows if r["kind"] == "part"}


def _read(spark: SparkSession, log: str, folders: list[str], parts: list[str]) -> DataFrame:
    """Rows of ranges of the state and of appends; older appends have a folder for each range."""
    paths = [*folders, *[f"{log}/events/{p}" for p in parts]]
    if not paths:
        return spark.createDataFrame([], EVENTS)
    return spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(*paths)


def current(spark: SparkSession, log: str) -> DataFrame:
    """The status of every run: the state, and the events that it does not hold yet."""
    folders, held = _stands(spark, log)
    fresh = [p for p in _parts(spark, log) if p not in held]
    rows = _read(spark, log, list(folders.values()), fresh)
    return latest(rows) if fresh else rows


def history(spark: SparkSession, log: str) -> DataFrame:
    """All events once, however often they were appended; those of a run lie together."""
    return _read(spark, log, [], _parts(spark, log)).where("run_id is not null").repartition("run_id").distinct()


def compact(spark: SparkSession, log: str) -> int:
    """Fold events into the state; returns how many ranges were written. Readers go from one whole state to the next.

    One writer at a time. A compaction that dies leaves the state that stood; the next one starts again from it.
    """
    folders, held = _stands(spark, log)
    fresh = [p for p in _parts(spark, log) if p not in held]
    if not fresh:
        return 0
    touched = sorted(r[0] for r in _read(spark, log, [], fresh).select(_range()).distinct().collect())
    version = uuid.uuid4().hex[:16]
    old = [folders[r] for r in touched if r in folders]
    root = f"{log}/ranges/{version}"
    _folded(_read(spark, log, old, fresh)).write.option("compression", "zstd").partitionBy("range").parquet(root)
    written = {r: f"{root}/range={r}" for r in touched if path_exists(spark, f"{root}/range={r}")}
    stands = folders | written
    record = [("range", r, f) for r, f in stands.items()] + [("part", None, p) for p in sorted(held | set(fresh))]
    number = int(_states(spark, log)[-1].rsplit("/", 1)[-1]) + 1 if _states(spark, log) else 1
    target = f"{log}/states/{number:012d}"
    remove(spark, target)  # of a compaction that died
    spark.createDataFrame(record, "kind string, range int, name string").coalesce(1).write.parquet(target)
    return len(written)


def status_events(status: DataFrame, at: Column, seq: Column) -> DataFrame:
    """Events out of :func:`skuloom.operators.registry.run_status`."""
    return status.select("run_id", "region", "status", "error", at.cast("timestamp").alias("at"), seq.cast("bigint").alias("seq"))


def terminated(running: DataFrame, at: Column, seq: Column) -> DataFrame:
    """Events that end every run still under way as failed."""
    return running.where(F.col("status") == RUNNING).select(
        "run_id", "region", F.lit(FAILED).alias("status"), F.lit("terminated").alias("error"), at.cast("timestamp").alias("at"), seq.cast("bigint").alias("seq")
    )
