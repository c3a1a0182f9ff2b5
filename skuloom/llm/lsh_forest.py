"""Near-duplicate documents through an LSH forest over MinHash signatures.

Each tree is one sorted order of the signatures: rotated so that it begins with other values. Rows that share DEPTH leading
values are a region. Within a region the depth adapts: a row's first candidate is the head of the longest prefix it shares,
deeper where the region is dense, and its second the head of the region. Candidates are confirmed on full shingle sets,
and after that only pairs of a region that are still in different components are compared, so no pair that shares
a region goes untested unless it is connected already.

Rows are sorted by range, so a region of any size spreads over tasks. Equal word sequences are one row from the start.
With TREES = 24 and DEPTH = 6 a pair of similarity 0.8 shares no region with probability (1 - 0.8^6)^24 = 0.0007.
Sketches of MinHash bits, of 128 bits for all rows and of 2048 where regions are not connected, drop candidates whose estimate is
3.9 standard deviations below the threshold or worse.

Defined cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; a text of fewer words
than a shingle has its whole sequence as one; equal texts share a component; rows with the same id are one document;
rows without id are returned unlinked, component null, kept. Other columns are ignored here and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.components import components
from skuloom.llm.rows import apart, free_name, only, without
from skuloom.llm.text import LOWER, SOLID_BYTES, flat, mix, pieces, release, span_hashes, spans
from skuloom.session import fresh_path, materialize

TREES, DEPTH, SKETCH_BITS, SKETCH_FAR = 24, 6, 128, 26
VALUES = TREES * DEPTH
CHUNK = 1 << 15

_rng = np.random.default_rng(99)
_FACTOR = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**64 - 1, VALUES, dtype=np.uint64)
# Text bytes that are hashed at a time.
SIGN_BYTES = 1 << 20
# A longer sketch, made only for rows whose region is not connected: 2048 bits, estimates to 0.013, again 3.9 deviations.
LONGS, LONG_FAR = 32, 257
# Rows whose 2048 values are held at a time: 8 MB.
LONG_ROWS = 1 << 10
_LONG_FACTOR = _rng.integers(0, 2**63, LONGS * 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_SHIFT = _rng.integers(0, 2**64 - 1, LONGS * 64, dtype=np.uint64)
_ROLL = _rng.integers(0, 2**63, DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = pa.struct(
    [("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]
    + [("keys", pa.list_(pa.int64())), ("deep", pa.list_(pa.int64()))]
)
_SIGNED_DDL = "struct<n_shingles:bigint,k1:bigint,k2:bigint,s1:bigint,s2:bigint,keys:array<bigint>,deep:array<bigint>>"


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order of text, shingles per text, two hashes of each word sequence)."""
    data = LOWER[data]
    starts, ends, before = spans(data, offsets, SOLID_BYTES)
    words, counts = span_hashes(data, starts, ends), np.diff(before)
    n = len(counts)
    text = np.repeat(np.arange(n), counts)
    place = (np.arange(len(words)) - before[:-1][text]).astype(np.uint64)
    k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(k1, text, mix(words + mix(place)))
    np.add.at(k2, text, mix(words ^ mix(place + np.uint64(1 << 40))))
    rolled = np.zeros(max(0, len(words)), np.uint64)
    for k in range(size):
        part = words[k:]
        rolled[: len(part)] = mix(rolled[: len(part)] + part * np.uint64(0x9E3779B97F4A7C15))
    whole = place.astype(np.int64) + size <= counts[text]
    short = (counts[text] < size) & (place == 0)
    if short.any():  # the whole sequence is the only shingle
        rolled[short] = k1[text[short]]
    keep = whole | short
    rolled, text = rolled[keep], text[keep]
    new = ~pd.Series(rolled ^ mix(text.astype(np.uint64))).duplicated().to_numpy()
    rolled, text = rolled[new], text[new]
    return rolled, np.bincount(text, minlength=n), k1, k2


def signatures(hashes: np.ndarray, counts: np.ndarray, factors: np.ndarray = _FACTOR, shifts: np.ndarray = _SHIFT) -> np.ndarray:
    """MinHash values, one row per text that has shingles."""
    counts = counts[counts > 0]
    begin = np.cumsum(counts) - counts
    out = np.empty((len(counts), len(factors)), np.uint32)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + CHUNK)))
        lo, hi = int(begin[at]), int(begin[to - 1] + counts[to - 1])
        part, cut, room = hashes[lo:hi], begin[at:to] - lo, np.empty(hi - lo, np.uint64)
        for k in range(len(factors)):
            np.multiply(part, factors[k], out=room)
            np.add(room, shifts[k], out=room)
            out[at:to, k] = np.minimum.reduceat(room, cut) >> np.uint64(32)
        at = to
    return out


def _signed(texts: pa.Array, size: int) -> pa.Array:
    data, offsets = flat(texts)
    parts = []
    for a, b in pieces(offsets, SIGN_BYTES):
        hashes, counts, k1, k2 = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        values = signatures(hashes, counts).astype(np.uint64)
        n, some = len(counts), counts > 0
        bits = (values[:, :SKETCH_BITS] & np.uint64(1)).astype(np.uint8)
        sketch = np.packbits(bits, axis=1).view(np.int64) if len(bits) else np.zeros((0, 2), np.int64)
        turned = values.reshape(-1, TREES, DEPTH)
        keys = mix((turned * _ROLL).sum(2, dtype=np.uint64)) if len(values) else np.zeros((0, TREES), np.uint64)
        following = np.roll(turned, -1, axis=1)
        deep = (following[:, :, 0] << np.uint64(32)) | following[:, :, 1]
        ends = np.concatenate([[0], np.cumsum(some * TREES)]).astype(np.int32)
        both = np.zeros((n, 2), np.int64)
        both[some] = sketch
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1).view(np.int64))) for x in (keys, np.ascontiguousarray(deep))]
        plain = [counts.astype(np.int64), k1.view(np.int64), k2.view(np.int64), both[:, 0], both[:, 1]]
        parts.append(pa.StructArray.from_arrays([*map(pa.array, plain), *lists], SIGNED.names))
    return pa.concat_arrays(parts) if parts else pa.array([], SIGNED)


def _sign(size: int):
    @F.arrow_udf(_SIGNED_DDL)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _signed(texts, size)
            release()

    return sign


def _shingle_set(size: int):
    @F.arrow_udf("array<bigint>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = flat(texts)
            hashes, ends = [], [np.zeros(1, np.int64)]
            for a, b in pieces(offsets, SIGN_BYTES):
                own, counts, _, _ = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                hashes.append(own)
                ends.append(ends[-1][-1] + np.cumsum(counts))
            values = np.concatenate(hashes).view(np.int64) if hashes else np.empty(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(values))
            del hashes, values
            release()

    return found


REGIONS = "tree int, key bigint, id bigint, s1 bigint, s2 bigint, near bigint, head bigint"


def _far(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a1 ^ b1).view(np.uint64)).astype(np.int64) + np.bitwise_count((a2 ^ b2).view(np.uint64))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in sorted order that share a region with a neighbour, with the heads of their longest prefix and region.

    Rows at the edges of a batch are passed on too, since their other neighbour is not seen here.
    """
    names = ["tree", "key", "deep", "id", "s1", "s2"]
    held = None  # the heads of the open region and of its two deeper prefixes, for rows of the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        own = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
        if held is not None:
            own = {c: np.concatenate([held[c], own[c]]) for c in names}
        skip, n = (0 if held is None else 3), len(own["id"])
        level = np.zeros(n, np.int64)  # prefix shared with the row before: none, region, one more value, two more
        same = (own["tree"][1:] == own["tree"][:-1]) & (own["key"][1:] == own["key"][:-1])
        high = own["deep"][1:] >> 32 == own["deep"][:-1] >> 32
        level[1:] = np.where(~same, 0, np.where(~high, 1, np.where(own["deep"][1:] == own["deep"][:-1], 3, 2)))
        index = np.arange(n)
        heads = []
        for depth in (1, 2, 3):
            begin = level < depth
            if skip:  # held rows are heads: of the region, of one more value, of two more
                begin[:3] = False
                begin[0] = True
                begin[1 : depth if depth < 3 else 3] = True
            heads.append(np.maximum.accumulate(np.where(begin, index, 0)))
        if skip:
            heads = [h.copy() for h in heads]
        region, one, two = heads
        near = np.where(two != index, two, np.where(one != index, one, region))
        joined = np.zeros(n, bool)
        joined[1:] = level[1:] > 0
        shared = joined.copy()
        shared[:-1] |= joined[1:]
        shared[[skip, n - 1]] = True
        close = lambda at: np.where(
            (at != index) & (_far(own["s1"], own["s2"], own["s1"][at], own["s2"][at]) <= SKETCH_FAR), own["id"][at], -1
        )
        out = np.flatnonzero(shared & (index >= skip))
        columns = [own[c][out] for c in ("tree", "key", "id", "s1", "s2")] + [close(near)[out], close(region)[out]]
        arrays = [pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:5])]
        arrays += [pa.array(c, mask=c == -1) for c in columns[5:]]
        last = n - 1
        held = {c: own[c][[region[last], one[last], two[last]]] for c in names}
        yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in REGIONS.split(", ")])
    release()


def _long_sketch():
    @F.arrow_udf("array<bigint>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sets in batches:
            hashes = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.concatenate([[0], np.cumsum(counts)])
            parts = [np.empty((0, LONGS), np.int64)]
            for a in range(0, len(counts), LONG_ROWS):
                b = min(a + LONG_ROWS, len(counts))
                values = signatures(hashes[cut[a] : cut[b]], counts[a:b], _LONG_FACTOR, _LONG_SHIFT)
                parts.append(np.packbits((values & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64))
            longs = np.concatenate(parts)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(longs) * LONGS + 1, LONGS), pa.int32()), pa.array(longs.reshape(-1)))
            release()

    return sketch


def _sets(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the wanted ids, stored."""
    found = only(texts, ids).select("id", _shingle_set(size)("text").alias("shingles"))
    return materialize(found, fresh_path(texts.sparkSession, "shingles"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have the wanted similarity."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("__a")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("__b")), "b")
    common = F.size(F.array_intersect("__a", "__b")).cast("bigint")
    union = F.size("__a") + F.size("__b") - common
    return two.where(common * 100 >= union * percent).select("a", "b")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row: documents linked when 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = rows.select("id", _sign(words)("text").alias("s")).select("id", "s.*")
    signed = materialize(signed, fresh_path(spark, "signatures"))
    classes = signed.where("n_shingles > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    classes = materialize(classes, fresh_path(spark, "classes"))

    of_class = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").where("n_shingles > 0")
    trees = of_class.select("id", "s1", "s2", F.posexplode(F.arrays_zip("keys", "deep")).alias("tree", "__t"))
    trees = trees.select("tree", F.col("__t.keys").alias("key"), F.col("__t.deep").alias("deep"), "id", "s1", "s2")
    order = ["tree", "key", "deep", "id"]
    regions = trees.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, REGIONS)
    regions = materialize(regions, fresh_path(spark, "regions"))

    # One or two candidates a row first: the smallest head, and that of the longest shared prefix in the first tree with one.
    heads = regions.where("near is not null or head is not null").groupBy("id").agg(
        F.min(F.least("near", "head")).alias("x"), F.min_by("near", "tree").alias("y")
    )
    pairs = heads.select("id", F.explode(F.array("x", "y")).alias("other")).where("other is not null and other <> id")
    texts = rows.where("id is not null")
    pairs = materialize(pairs.select(*_ordered(F.col("id"), F.col("other"))).distinct(), fresh_path(spark, "pairs"))
    first = _confirmed(pairs, _sets(texts, _ends(pairs), words), percent)
    joined = materialize(components(first), fresh_path(spark, "components"))

    # Then whatever shares a region and is not connected yet. Rows of a region's largest component need no pairs among themselves.
    known = joined.select(F.col("node").alias("id"), F.col("component").alias("__c"))
    placed = regions.select("tree", "key", "id", "s1", "s2").join(known, "id", "left")
    placed = placed.withColumn("c", F.coalesce("__c", "id")).drop("__c")
    counts = placed.groupBy("tree", "key", "c").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("tree", "key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    placed = materialize(placed.join(mixed.drop("parts"), ["tree", "key"]), fresh_path(spark, "mixed"))
    if not placed.isEmpty():
        sets = _sets(texts, placed.select("id").distinct(), words)
        longs = [f"l{k}" for k in range(LONGS)]
        sketched = sets.select("id", F.size("shingles").alias("n"), _long_sketch()("shingles").alias("__l"))
        sketched = sketched.select("id", "n", *[F.get("__l", F.lit(k)).alias(c) for k, c in enumerate(longs)])
        spots = [f"k{t}" for t in range(TREES)]
        spotted = signed.select("id", *[F.get("keys", F.lit(t)).alias(c) for t, c in enumerate(spots)])
        spotted = placed.select("id").distinct().join(spotted, "id").dropDuplicates(["id"])
        placed = placed.join(sketched, "id").join(spotted, "id")
        a, b = placed.where("c <> main").alias("a"), placed.alias("b")

        def far(columns: list[str]) -> Column:
            return sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in columns[1:]), F.bit_count(F.col(f"a.{columns[0]}").bitwiseXOR(F.col(f"b.{columns[0]}"))))

        sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
        close = sizes & (far(["s1", "s2"]) <= SKETCH_FAR) & (far(longs) <= LONG_FAR)
        once = (F.col("b.c") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))
        same = (F.col("a.tree") == F.col("b.tree")) & (F.col("a.key") == F.col("b.key"))
        # A pair is made by the first tree in which it shares a region, so none is made twice.
        new = reduce(and_, [(F.col("a.tree") <= t) | (F.col(f"a.{c}") != F.col(f"b.{c}")) for t, c in enumerate(spots)])
        rest = a.join(b, same & (F.col("a.c") != F.col("b.c")) & once & close & new).select(*_ordered(F.col("a.id"), F.col("b.id")))
        rest = materialize(rest, fresh_path(spark, "rest"))
        more = _confirmed(rest, sets, percent)
        stars = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        joined = components(stars.unionAll(more))

    of = signed.select(F.col("id").alias(key), "n_shingles", "k1", "k2").join(
        classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
            "k1", "k2", F.coalesce("component", "rep").alias("__component")
        ),
        ["k1", "k2"],
        "left",
    )
    alone = F.when(F.col("n_shingles") == 0, F.col(key)).when(F.col(key).isNotNull(), F.col("__component"))
    return of.select(key, "n_shingles", alone.alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those whose component has a smaller id, columns as before.

    Rows that share an id are one document only if they have one text: of those one stays (the smallest by a hash of its other columns).
    Rows of one id with different texts are documents of their own, after all others in order. Rows without id stay.
    """
    rows, own, _ = apart(docs, key, text)
    found = materialize(near_duplicates(rows, own, text, **options), fresh_path(docs.sparkSession, "near_duplicates"))
    gone = found.where(F.col("component_id") != F.col(own)).select(F.col(own).alias("id")).distinct()
    again = found.where(F.col(own) == F.col("component_id")).groupBy(F.col(own).alias("id")).count().where("count > 1").select("id")
    kept = without(rows, own, gone)
    if again.isEmpty():
        return kept.drop(own)
    plain = [f.name for f in docs.schema if f.name != text and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = _among(kept, own, again).groupBy(own).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("__one"))
    return without(kept, own, again).drop(own).unionByName(one.select("__one.*"))


def _among(rows: DataFrame, own: str, ids: DataFrame) -> DataFrame:
    other = free_name(rows, "__gone")
    return rows.join(ids.withColumnRenamed("id", other), F.col(own) == F.col(other), "left_semi")
