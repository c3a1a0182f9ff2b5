"""Latency statistics of full batches while samples arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skuloom.operators.latency import BATCH
from skuloom.session import state_in_rocks_db

QUANTILES = (0.50, 0.95)


class OpenBatch(StatefulProcessor):
    """State of a group: the samples of its open batch, fewer than a batch, and how many batches are done.

    Samples of one micro-batch are taken in order of their number; micro-batches in the order in which they come.
    """

    def __init__(self, group: list[str], seq: str, ms: list[str], batch: int) -> None:
        self.group, self.seq, self.ms, self.batch = group, seq, ms, batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = T.StructType([T.StructField(c, T.DoubleType()) for c in self.ms])
        self.open = handle.getListState("open", values)
        self.done = handle.getValueState("done", T.StructType([T.StructField("batches", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        arrived = pd.concat([r[[self.seq, *self.ms]] for r in rows]).sort_values(self.seq, kind="stable")
        new = arrived[self.ms].to_numpy(dtype=float)
        held = [tuple(v) for v in self.open.get()] if self.open.exists() else []
        samples = np.concatenate([np.array(held, dtype=float).reshape(-1, len(self.ms)), new])
        done = self.done.get()[0] if self.done.exists() else 0
        full = len(samples) // self.batch
        if full:
            yield self._stats(key, samples[: full * self.batch].reshape(full, self.batch, len(self.ms)), done)
            self.done.update((done + full,))
        rest = samples[full * self.batch :]
        self.open.clear()
        if len(rest):
            self.open.put([tuple(None if np.isnan(v) else float(v) for v in r) for r in rest])

    def _stats(self, key: tuple, batches: np.ndarray, done: int) -> pd.DataFrame:
        numbers = done + np.arange(len(batches))
        out = {g: [k] * len(batches) for g, k in zip(self.group, key, strict=True)}
        out |= {"first_n": numbers * self.batch + 1, "last_n": (numbers + 1) * self.batch}
        ordered = np.sort(batches, axis=1)  # missing times come last
        known = (~np.isnan(batches)).sum(axis=1)
        for i, c in enumerate(self.ms):
            for q in QUANTILES:
                at = np.minimum(known[:, i] - 1, np.floor(q * known[:, i]).astype(int))
                value = np.take_along_axis(ordered[:, :, i], np.maximum(at, 0)[:, None], axis=1)[:, 0]
                out[f"{c}_p{round(q * 100)}"] = np.where(at >= 0, value, np.nan)
        return pd.DataFrame(out)

    def close(self) -> None:
        pass


def batch_stats(samples: DataFrame, group: list[str], seq: str, ms: list[str], batch: int = BATCH) -> DataFrame:
    """The stream form of :func:`skuloom.operators.latency.batch_stats`: a batch is reported when its last sample has come.

    A group is one key of the state and worked on in order, so it is one task's work in a micro-batch; ``maxFilesPerTrigger`` bounds that.
    """
    kinds = [T.StructField(g, samples.schema[g].dataType) for g in group]
    fields = [*kinds, T.StructField("first_n", T.LongType()), T.StructField("last_n", T.LongType())]
    fields += [T.StructField(f"{c}_p{round(q * 100)}", T.DoubleType()) for c in ms for q in QUANTILES]
    return samples.select(*group, seq, *ms).groupBy(*group).transformWithStateInPandas(
        OpenBatch(group, seq, ms, batch), T.StructType(fields), "Append", "None"
    )


def to_files(stats: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append what is reported as Parquet; the checkpoint keeps the open batches for a restart."""
    writer = stats.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    with state_in_rocks_db(stats.sparkSession):
        return (writer.trigger(availableNow=True) if available_now else writer).start(path)
