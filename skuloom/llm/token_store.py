"""Token ids on disk: one shared zstandard dictionary, every document its own frame, an offset index per block.

A store is a folder with two Parquet tables: ``dictionary`` (one row: SHA-256 and bytes) and ``blocks``. A block
row holds the frames of consecutive documents in key order, glued together, with their keys, id counts
and byte offsets, so one document is read by cutting out and decoding one short frame.

Defined cases: null and empty texts hold the end id alone; rows of one key are kept apart, ordered by a hash of
their text; null keys come first; an empty table gives an empty store. Other columns of the input are not stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuloom.llm.bpe import encoder
from skuloom.llm.text import release

#: The dictionary is fitted on about SAMPLE_DOCS documents, those with the smallest key hashes, if they have SAMPLE_TEXT bytes at most.
SAMPLE_DOCS, SAMPLE_TEXT = 1_500, 32 << 10
DICTIONARY_BYTES, LEVEL, BLOCK_BYTES = 64 << 10, 3, 1 << 20
BLOCKS = (
    "part int, before bigint, n_ids bigint, dictionary string, width int, first_key bigint, last_key bigint, "
    "keys array<bigint>, sizes array<int>, offsets array<bigint>, frames binary"
)
DOCUMENTS = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>"


def _serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def id_width(name: str, end_id: int) -> int:
    return 2 if max(encoder(name).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def train_dictionary(rows: DataFrame, name: str, end_id: int) -> bytes:
    """Dictionary bytes, empty where the corpus is too small to fit one. ``rows`` has ``key`` and ``text``."""
    width = id_width(name, end_id)

    @F.arrow_udf("binary")
    def serialized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_serialized(np.append(ids, end_id), width) for ids in encoder(name).encode(texts)], pa.binary())

    # Hashes are uniform, so their smallest SAMPLE_DOCS-th of all rows needs no sorting.
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    few = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(share * (1 << 40)))
    few = few.where(F.octet_length("text") <= SAMPLE_TEXT).limit(2 * SAMPLE_DOCS)
    samples = [bytes(r[0]) for r in few.select(serialized("text")).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _zstd(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_store(docs: DataFrame, path: str, name: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Encode ``text`` with the public tokenizer ``name``, append ``end_id``, store in ascending order of ``key``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    dictionary = train_dictionary(rows, name, end_id)
    digest, width = hashlib.sha256(dictionary).hexdigest(), id_width(name, end_id)
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zstd(dictionary), write_content_size=True)
        part, before = TaskContext.get().partitionId(), 0
        keys, sizes, frames, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            known = [k for k in keys if k is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int64)
            row = (part, before, sum(sizes), digest, width, min(known, default=None), max(known, default=None), keys, sizes, offsets, b"".join(frames))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            kinds += (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
            fields = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], fields)

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), encoder(name).encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                frames.append(press.compress(_serialized(ids, width)))
                keys.append(k)
                sizes.append(len(ids))
                held += len(frames[-1])
                if held >= BLOCK_BYTES:
                    yield flush()
                    before += sum(sizes)
                    keys, sizes, frames, held = [], [], [], 0
            release()
        if keys:
            yield flush()

    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """One row of at most DICTIONARY_BYTES."""
    digest, data = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(data)
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"the dictionary of {path} does not have its hash")
    return digest, data


def _ids(frame: bytes, width: int) -> np.ndarray:
    return np.frombuffer(frame, "<u2" if width == 2 else "<u4").astype("<u4")


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document: key, start (ids before it in key order), n_tokens, ids_crc32 (ids as little-endian u32), ids."""
    digest, dictionary = _dictionary(spark, path)
    stored = spark.read.parquet(f"{path}/blocks")
    # One small row per written partition; blocks know the ids before them in their own partition.
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("__sum"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    placed = stored.join(parts, "part").withColumn("start", F.col("__offset") + F.col("before"))
    columns = ["start", "dictionary", "width", "keys", "sizes", "offsets", "frames"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor(dict_data=_zstd(dictionary))
        for batch in batches:
            for b in batch.to_pylist():
                if b["dictionary"] != digest:
                    raise ValueError("block written with another dictionary")
                at, raw = b["offsets"], b["frames"]
                ids = [_ids(open_.decompress(raw[s:e]), b["width"]) for s, e in zip(at, at[1:], strict=False)]
                if [len(x) for x in ids] != b["sizes"]:
                    raise ValueError("a frame does not hold the ids its index says")
                sizes = np.array(b["sizes"], np.int64)
                cut = np.concatenate([[0], np.cumsum(sizes)])
                ends = pa.array(cut if with_ids else np.zeros(len(cut)), pa.int32())
                values = pa.array(np.concatenate(ids).astype(np.int32) if with_ids else [], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b["keys"], pa.int64()),
                        pa.array(b["start"] + cut[:-1], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        pa.ListArray.from_arrays(ends, values),
                    ],
                    ["key", "start", "n_tokens", "ids_crc32", "ids"],
                )

    rows = placed.select(*columns).mapInArrow(documents, DOCUMENTS)
    return rows if with_ids else rows.drop("ids")


def read_documents(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the wanted keys: frames are cut out by the offset index and only those are decoded."""
    digest, dictionary = _dictionary(spark, path)

    @F.arrow_udf("array<int>")
    def decoded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        open_ = zstandard.ZstdDecompressor(dict_data=_zstd(dictionary))
        for frames, widths in batches:
            pairs = zip(frames.to_pylist(), widths.to_pylist(), strict=True)
            yield pa.array([_ids(open_.decompress(f), w).astype(np.int32) for f, w in pairs], pa.list_(pa.int32()))

    wanted = keys.select(F.col(key).cast("bigint").alias("key")).where("key is not null").distinct()
    held = spark.read.parquet(f"{path}/blocks").where(F.col("dictionary") == digest)
    held = held.select("width", "offsets", "frames", F.posexplode("keys").alias("__i", "key"))
    low, high = F.get("offsets", F.col("__i")), F.get("offsets", F.col("__i") + 1)
    cut = held.select("key", "width", F.substring("frames", low.cast("int") + 1, (high - low).cast("int")).alias("frame"))
    return cut.join(wanted, "key", "left_semi").select("key", decoded("frame", "width").alias("ids"))
