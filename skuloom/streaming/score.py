"""Online scoring: a stream of requests joined with the static model table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skuloom.operators import lookup


def score_stream(requests: DataFrame, served: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The batch scoring job on a stream: a stream-static join, so no state is kept.

    Every micro-batch reads ``served`` anew, so it should be a stored table. Streams run without adaptive skew handling:
    ``counts``, stored request counts per key, name the hot keys whose models are copied.
    """
    return lookup.score(requests, served, counts)


def to_files(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append predictions as Parquet; the checkpoint makes a restarted stream go on where it stopped."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
