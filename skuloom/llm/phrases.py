"""Phrases whose words stand together more often than chance: frequent n-grams by Misra-Gries summaries, exact counts, scores of cuts.

Phrases do not cross a piece, the text between two marks of ``.,;:!?`` or line ends, and are counted by group (a language).

1. Runs of words are hashed and dealt to hash partitions. Each partition is summed up by a Misra-Gries summary whose capacity
   exceeds the partition's mass divided by the threshold: every run that occurs that often survives. Summaries of blocks are merged
   as they arrive. Runs of one and two words come first; longer ones are made only where all their pairs survived.
2. A bit map of the survivors (16 MB at most, whatever their number) goes back to the texts, where the runs that hit it are told apart
   by their words and counted exactly. What the map lets through by chance is dropped by its count.
3. Candidates meet the counts of both parts of each cut by joins; products are decimals of 38 digits.

Defined cases: a null text has no words; a null group is ``und``; rows that repeat an id count one by one; texts of any length are cut
between pieces, so a task holds a piece at least and some megabytes at most; equal scores are ordered by count, then by the bytes of
the phrase; an empty table has no phrases. Only the group and the text of a row are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skuloom.llm.text import LOWER, PIECE_BYTES, distinct_spans, flat, mix, positions, release, span_hashes, spans
from skuloom.session import fresh_path, materialize

LONGEST, THRESHOLD, TOP = 5, 100, 2000
NO_GROUP = "und"
#: Text bytes for one hash partition; a word has six on average and begins a run of each length.
PARTITION_BYTES = 1 << 25
#: Runs that a task sums up before it sends them.
BLOCK_RUNS = 1 << 21
#: Counts that a task holds before it sends them.
HELD_ROWS = 1 << 20
FILTER_BITS, FILTER_ROW = 1 << 27, 1 << 15

_CODES = np.arange(256)
_MARKS = np.isin(_CODES, list(b".,;:!?\n\x0b\x0c\r"))
_WORD_BYTES = ~(_MARKS | np.isin(_CODES, list(b" \t")))
_STEP = np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64(0xFFFFFFFF)

BLOCKS = "bucket int, kind int, mass bigint, keys binary, counts binary"
COUNTED = "grp string, phrase string, size int, n bigint"


def _chunks(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end with a text or a mark, further on where there is none."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + limit, n)
        if to < n:
            ends = offsets[np.searchsorted(offsets, to, "right") - 1]
            marks = np.flatnonzero(_MARKS[data[at:to]])
            best = max(int(ends), at + int(marks[-1]) + 1 if len(marks) else 0)
            while best <= at:  # one piece is longer than the limit
                nearest = int(offsets[min(np.searchsorted(offsets, to, "left"), len(offsets) - 1)])
                marks = np.flatnonzero(_MARKS[data[to : to + limit]])
                best = min(nearest, to + int(marks[0]) + 1) if len(marks) else nearest if nearest <= to + limit else 0
                to += limit
            to = best
        yield at, to
        at = to


class _Words:
    """The words of a chunk: places, piece and group of each, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> None:
        self.data = LOWER[data]
        self.starts, self.ends, before = spans(self.data, offsets, _WORD_BYTES)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        marks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_MARKS[self.data], out=marks[1:])
        self.piece = marks[self.starts] + text
        self.group = groups[text]
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def together(self, at: np.ndarray, more: int) -> np.ndarray:
        """Those places whose word stands in one piece with the ``more``-th word after it."""
        at = at[at + more < len(self.piece)]
        return at[self.piece[at] == self.piece[at + more]]


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[_Words, pa.Array]]:
    groups = pc.fill_null(batch.column("grp").cast(pa.string()), NO_GROUP).dictionary_encode()
    codes = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    data, offsets = flat(batch.column("text"))
    for a, b in _chunks(data, offsets, PIECE_BYTES):
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        yield _Words(data[a:b], np.clip(offsets[first : last + 1] - a, 0, b - a), codes[first:last]), groups.dictionary


def _salts(groups: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") for g in groups.to_pylist()], np.uint64)


def _spot(key: np.ndarray) -> np.ndarray:
    return (mix(key) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _hit(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    spot = _spot(key)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def _keyed(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hash partition in the upper half, 32 bits of the hash in the lower: runs that share both are counted as one, which only adds."""
    return (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & _LOW)


def _runs(words: _Words, salts: np.ndarray, sizes: range, buckets: int, bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, keys) of the runs of every size in the chunk; with a bit map only those whose pairs are all in it."""
    if not len(words.starts):
        return
    at = np.arange(len(words.starts))
    h = mix(words.hashes ^ salts[words.group])
    pairs = None
    for size in range(1, max(sizes, default=0) + 1):
        if size > 1:
            kept = words.together(at, size - 1)
            if bits is not None and size > 2:
                kept = kept[pairs[kept] & pairs[kept + size - 2]] if size == 3 else kept[pairs[kept + size - 2]]
            h = mix(h[np.searchsorted(at, kept)] * _STEP + words.hashes[kept + size - 1])
            at = kept
        if bits is not None and size == 2:
            pairs = np.zeros(len(words.starts), bool)
            pairs[at] = _hit(bits, _keyed(h, buckets))
        if size in sizes:
            yield size, at, _keyed(h, buckets)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _planes(values: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, all lowest ones first: the upper planes of small numbers are zeros, which the shuffle compresses."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _block_rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """For every hash partition its mass, ahead of all blocks when sorted by kind, and the runs with their counts; one run at least."""
    keys, counts = _summed(keys, counts)
    bucket = (keys >> np.uint64(32)).astype(np.int32)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rows: list[tuple] = []
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(bucket)).tolist(), strict=True):
        own = (keys[a:b] & _LOW).astype(np.int64)
        rows.append((int(bucket[a]), 0, int(counts[a:b].sum()), None, None))
        rows.append((int(bucket[a]), 1, None, _planes(np.diff(own, prepend=0)), _planes(counts[a:b])))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])


def _blocks(sizes: range, buckets: int, shared: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared is not None else None
        held: list[np.ndarray] = []
        for batch in batches:
            for words, groups in _chunked(batch):
                held += [keys for _, _, keys in _runs(words, _salts(groups), sizes, buckets, bits) if len(keys)]
                if sum(map(len, held)) >= BLOCK_RUNS:
                    keys, held = np.concatenate(held), []
                    yield _block_rows(keys, np.ones(len(keys), np.int64))
            release()
        if held:
            keys = np.concatenate(held)
            yield _block_rows(keys, np.ones(len(keys), np.int64))

    return blocks


class MisraGries:
    """Counters of the runs of one hash partition; a run of frequency f keeps at least f - ``lost`` > f - threshold."""

    def __init__(self, mass: int, threshold: int, pending: int = BLOCK_RUNS) -> None:
        self.capacity, self.threshold, self.pending = mass // threshold + 1, threshold, max(pending, mass // threshold + 1)
        self.keys, self.counts, self.lost = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._waits = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._waits += len(keys)
        if self._waits >= self.pending:
            self._merge()

    def _merge(self) -> None:
        parts = [(self.keys, self.counts), *self._waiting]
        keys, counts = _summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        if len(keys) > self.capacity:
            # The counters beyond the capacity, and as much of every other one, go: each unit lost takes capacity + 1 of the mass.
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keep = counts > cut
            keys, counts, self.lost = keys[keep], counts[keep] - cut, self.lost + cut
        self.keys, self.counts, self._waiting, self._waits = keys, counts, [], 0

    def survivors(self) -> np.ndarray:
        """Every run that occurs ``threshold`` times, and those that might by their counter."""
        self._merge()
        return self.keys[self.counts + self.lost >= self.threshold]


def _survivors(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places in the bit map of what survives; rows come sorted by partition and kind, so masses precede blocks."""

    def spots(bucket: int, summary: MisraGries) -> pa.RecordBatch:
        key = summary.survivors() | (np.uint64(bucket) << np.uint64(32))
        return pa.RecordBatch.from_arrays([pa.array(np.unique(_spot(key)))], ["spot"])

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mass, summary = None, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != own:
                    if summary is not None:
                        yield spots(own, summary)
                    own, mass, summary = row["bucket"], 0, None
                if row["kind"] == 0:
                    mass += row["mass"]
                    continue
                summary = summary or MisraGries(mass, threshold)
                keys = np.cumsum(_numbers(row["keys"]).astype(np.uint64), dtype=np.uint64)
                summary.add(keys, _numbers(row["counts"]).astype(np.int64))
            release()
        if summary is not None:
            yield spots(own, summary)

    return survive


def _bit_map(rows: DataFrame, sizes: range, buckets: int, threshold: int, shared: Broadcast | None) -> np.ndarray:
    """The survivors of the runs of these sizes. The driver gets at most 4,096 rows of 4 KB."""
    blocks = rows.mapInArrow(_blocks(sizes, buckets, shared), BLOCKS).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    spots = blocks.mapInArrow(_survivors(threshold), "spot bigint")
    row = F.floor(F.col("spot") / F.lit(FILTER_ROW)).cast("int").alias("row")
    maps = spots.groupBy(row).agg(F.bitmap_construct_agg(F.col("spot") % F.lit(FILTER_ROW)).alias("map"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for at, own in maps.collect():
        bits[at * FILTER_ROW // 8 : (at + 1) * FILTER_ROW // 8] = np.frombuffer(own, np.uint8)
    return bits


def _summed_counts(held: list[pa.RecordBatch]) -> pa.Table:
    keys = [c for c in held[0].schema.names if c != "n"]
    found = pa.Table.from_batches(held).group_by(keys).aggregate([("n", "sum")])
    return found.rename_columns([*keys, "n"]).select(held[0].schema.names).combine_chunks()


def _packed(table: pa.Table) -> pa.RecordBatch:
    """One row per hash partition: its counts as an Arrow stream."""
    table = table.sort_by("bucket")
    bucket = table["bucket"].to_numpy()
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    blocks = []
    for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema.remove(0)) as out:
            out.write_table(table.slice(a, b - a).drop_columns("bucket"))
        blocks.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "block"])


def _counted(shorter: Broadcast, longer: Broadcast, longest: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by words, not hashes, of the runs in the bit maps, packed by hash partition; a run goes on only from one in its map itself."""
    names = ["bucket", *(f.split()[0] for f in COUNTED.split(", "))]

    def rows(bucket: np.ndarray, groups: pa.Array, found: pa.Array, size: int, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(bucket.astype(np.int32)), groups, found, pa.array(np.full(len(n), size, np.int32)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts of several chunks are added up before they leave the task.
        held, n_held = [], 0
        for found in of_chunks(batches):
            held.append(found)
            n_held += found.num_rows
            if n_held >= HELD_ROWS:
                summed = _summed_counts(held)
                held, n_held = summed.to_batches(), summed.num_rows
                if n_held >= HELD_ROWS // 2:
                    yield _packed(summed)
                    held, n_held = [], 0
        if held:
            yield _packed(_summed_counts(held))

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, groups in _chunked(batch):
                if not len(words.starts):
                    continue
                own, n = np.unique(words.group, return_counts=True)
                yield rows(np.zeros(len(own)), groups.take(pa.array(own)), pa.array([""] * len(own)), 0, n)
                first, codes = distinct_spans(words.data, words.starts, words.ends)
                sizes = words.ends[first] - words.starts[first]
                offsets = np.zeros(len(first) + 1, np.int64)
                np.cumsum(sizes, out=offsets[1:])
                letters = words.data[positions(words.starts[first], sizes)]
                distinct = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters))
                classes, alive = words.group, None
                for size, at, keys in _runs(words, _salts(groups), range(1, longest + 1), buckets, shorter.value):
                    hit = _hit(shorter.value if size <= 2 else longer.value, keys)
                    if alive is not None:
                        hit &= alive[at]
                    at, keys = at[hit], keys[hit]
                    if not len(at):
                        break
                    pair = classes[at].astype(np.int64) * len(first) + codes[at + size - 1]
                    _, place, code, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                    classes, alive = np.zeros(len(words.starts), np.int64), np.zeros(len(words.starts), bool)
                    classes[at], alive[at] = code, True
                    begin = at[place]
                    parts = [distinct.take(pa.array(codes[begin + k])) for k in range(size)]
                    found = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
                    yield rows(keys[place] >> np.uint64(32), groups.take(pa.array(words.group[begin])), found, size, n)
            release()

    return counted


def _frequent(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the counts of a hash partition; every block of a partition is in one task."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, kept = [], 0, 0
        for batch in batches:
            for block in batch.column("block"):
                found = pa.ipc.open_stream(block.as_buffer()).read_all()
                held += found.to_batches()
                n_held += found.num_rows
                if n_held >= max(HELD_ROWS, 2 * kept):
                    held = _summed_counts(held).to_batches()
                    n_held = kept = sum(b.num_rows for b in held)
        if held:
            total = _summed_counts(held)
            yield from total.filter(pc.or_(pc.equal(total["size"], 0), pc.greater_equal(total["n"], threshold))).to_batches()

    return frequent


def frequent_runs(docs: DataFrame, text: str = "text", group: str = "lang", longest: int = LONGEST, threshold: int = THRESHOLD) -> DataFrame:
    """Exact counts of all runs of 1 to ``longest`` words that occur ``threshold`` times in their group: (grp, phrase, size, n).

    Size 0 is the number of words of the group.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // PARTITION_BYTES + 1
    shorter = spark.sparkContext.broadcast(_bit_map(rows, range(1, 3), buckets, threshold, None))
    longer = spark.sparkContext.broadcast(_bit_map(rows, range(3, longest + 1), buckets, threshold, shorter))
    blocks = rows.mapInArrow(_counted(shorter, longer, longest, buckets), "bucket int, block binary").repartitionById(buckets, "bucket")
    found = materialize(blocks.mapInArrow(_frequent(threshold), COUNTED), fresh_path(spark, "runs"))
    shorter.destroy()
    longer.destroy()
    return found


def collocations(
    docs: DataFrame, text: str = "text", group: str = "lang", longest: int = LONGEST, threshold: int = THRESHOLD, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of each group by the score of their weakest cut: (grp, rank, phrase, a, l, r, n, score).

    A phrase that stands in a longer candidate as often as anywhere is left out. One word more is enough to look at: a run between
    the two occurs as often as both.
    """
    counts = frequent_runs(docs, text, group, longest, threshold)
    runs = counts.where("size > 0")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in "alrn"}
    words = F.split("phrase", " ", -1)
    inner = runs.where("size > 2").select(
        "grp",
        F.col("n").alias("inner_n"),
        F.explode(F.array(*[F.array_join(F.slice(words, start, F.col("size") - 1), " ") for start in (1, 2)])).alias("inner"),
    )
    candidates = runs.where("size > 1")
    same = (candidates["grp"] == inner["grp"]) & (F.col("phrase") == F.col("inner")) & (F.col("n") == F.col("inner_n"))
    candidates = candidates.join(inner, same, "left_anti")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("grp", "phrase", F.col("n").alias("a"), "size", cut)
    cuts = cuts.withColumn("left", F.array_join(F.slice(words, F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")).drop("size")
    cuts = cuts.join(runs.select("grp", F.col("phrase").alias("left"), F.col("n").alias("l")), ["grp", "left"])
    cuts = cuts.join(runs.select("grp", F.col("phrase").alias("right"), F.col("n").alias("r")), ["grp", "right"])
    cuts = cuts.join(counts.where("size = 0").select("grp", "n"), "grp")
    score = F.expr("(1000BD * a * n) div (l * r)")
    scored = cuts.select("grp", "phrase", "k", *[wide[c].alias(c) for c in "alrn"]).select("*", score.alias("score"))
    weakest = scored.groupBy("grp", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("grp", "phrase", "cut.*")
    order = W.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("grp", F.col("rank").cast("bigint").alias("rank"), "phrase", *[F.col(c).cast("bigint").alias(c) for c in "alrn"], "score")
