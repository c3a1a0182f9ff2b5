"""Near-duplicate vectors through a forest of random-projection trees with spill.

A node is cut by a random direction at a threshold near the median, where vectors are sparse; vectors within the spill of the
threshold go to both sides. Trees are fitted on a bounded sample of a node (NODE_SAMPLE vectors), every vector is routed,
and nodes that still hold more than LEAF vectors are cut again in the next round, until all are small or tight: in a
tight node the vectors link with each other on average, so its pairs are answers, not candidates. Leaves are compared in double
precision, large tight ones in tiles of bounded size. The number of trees follows from the depth, so that a
pair at the threshold is missed with probability MISS at most by the model in :func:`trees_for`.

Defined cases: null and zero vectors and those with null or non-finite components link with nothing; equal vectors are compared
once and counted as often as they occur; vectors of different lengths never link; rows without id get no component; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.llm.components import components
from skuloom.session import fresh_path, materialize

COSINE = 0.9
LEAF, NODE_SAMPLE, SAMPLE_LEAF, TILE = 400, 20_000, 16, 1_000
#: Spill on either side of a threshold, in standard deviations of the projected distance of a pair at COSINE.
SPILL, MISS = 0.25, 0.003
#: Tree models broadcast at once; each has NODE_SAMPLE / SAMPLE_LEAF leaves at most.
MODELS = 500
#: Bytes of an ordinary model: as many as MODELS of them go to the tasks at a time, more small ones or fewer large ones.
MODEL_BYTES = 1 << 17
LINKS = "a bigint, b bigint"


def trees_for(n: int) -> int:
    """Trees so that a pair at COSINE meets in a leaf of one with probability 1 - MISS.

    A cut near the median of a spread-out node parts such a pair with probability 0.07: its projected distance has deviation
    s = sqrt(2 - 2 COSINE) / sqrt(dim), must exceed the double spill, and the density there is 0.4 sqrt(dim).
    """
    kept = 0.93 ** max(0.0, math.log2(max(1, n) / LEAF))
    return max(4, math.ceil(math.log(MISS) / math.log(max(1e-9, 1 - kept))))


class TreeModel:
    """Cuts of one node: directions are drawn from the seed and the cut's number."""

    def __init__(self, seed: int, dim: int) -> None:
        self.seed, self.dim = seed, dim
        self.cuts: list[tuple[float, int, int]] = []  # threshold, left, right; a leaf is -1 - number
        self.tight: list[bool] = []

    def direction(self, cut: int) -> np.ndarray:
        d = np.random.default_rng([self.seed, cut]).normal(size=self.dim)
        return d / np.linalg.norm(d)

    @property
    def spill(self) -> float:
        return SPILL * math.sqrt((2 - 2 * COSINE) / self.dim)

    def fit(self, x: np.ndarray, leaf: int) -> TreeModel:
        self._grow(x, leaf)
        return self

    def _end(self, tight: bool) -> int:
        self.tight.append(tight)
        return -len(self.tight)

    def _grow(self, x: np.ndarray, leaf: int) -> int:
        if len(x) <= leaf:
            return self._end(False)
        mean = x.mean(0)
        if mean @ mean >= COSINE:
            return self._end(True)
        number = len(self.cuts)
        self.cuts.append((0.0, 0, 0))
        p = np.sort(x @ self.direction(number))
        choice = p[(np.array([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]) * len(p)).astype(int)]
        wide = 2 * self.spill
        near = np.searchsorted(p, choice + wide, "right") - np.searchsorted(p, choice - wide, "left")
        at = float(choice[np.argmin(near)])
        p = x @ self.direction(number)
        low, high = p <= at + self.spill, p > at - self.spill
        if low.all() or high.all():  # the spill holds them all
            self.cuts[number] = (math.inf, self._end(True), 0)
            return number
        left = self._grow(x[low], leaf)
        self.cuts[number] = (at, left, self._grow(x[high], leaf))
        return number

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaf numbers): a row in every leaf it reaches."""
        if not self.cuts:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, leaves, stack = [], [], [(0, np.arange(len(x)))]
        while stack:
            node, of = stack.pop()
            if node < 0:
                rows.append(of)
                leaves.append(np.full(len(of), -1 - node))
            elif len(of):
                at, left, right = self.cuts[node]
                if math.isinf(at):
                    stack.append((left, of))
                    continue
                p = x[of] @ self.direction(node)
                stack += [(left, of[p <= at + self.spill]), (right, of[p > at - self.spill])]
        return np.concatenate(rows), np.concatenate(leaves)


def _units(vectors: pa.Array, n: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The model of one node, from its sample."""
    x = np.stack(pdf.sort_values("rep")["vector"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    node, size = pdf["node"].iloc[0], int(pdf["size"].iloc[0])
    leaf = max(SAMPLE_LEAF, int(LEAF * len(x) / size))
    model = TreeModel(zlib.crc32(node.encode()), x.shape[1]).fit(x, leaf)
    return pd.DataFrame({"node": [node], "model": [pickle.dumps(model)]})


def _routed(rows: DataFrame, models: dict[str, bytes]) -> DataFrame:
    """(node, done, rep, vector): every row in the leaves of its node's model."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, TreeModel] = {}
        for batch in batches:
            node = np.array(batch.column("node").to_pylist(), object)
            for name in pd.unique(node):
                own = batch.take(pa.array(np.flatnonzero(node == name)))
                model = loaded.get(name) or loaded.setdefault(name, pickle.loads(shared.value[name]))
                at, leaf = model.route(_units(own.column("vector"), own.num_rows))
                out = own.take(pa.array(at))
                names = pa.array([f"{name}.{k}" for k in leaf.tolist()], pa.string())
                done = pa.array(np.array(model.tight)[leaf], pa.bool_())
                yield pa.RecordBatch.from_arrays([names, done, out.column("rep"), out.column("vector")], ["node", "done", "rep", "vector"])

    return rows.mapInArrow(route, "node string, done boolean, rep bigint, vector array<double>")


def leaves(reps: DataFrame, trees: int) -> DataFrame:
    """(node, size, rep, vector) of all leaves of all trees."""
    spark = reps.sparkSession
    numbers = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = reps.select("rep", "vector", numbers.alias("__t"))
    rows = rows.select(F.concat_ws("/", "__t", F.size("vector")).alias("node"), F.lit(False).alias("done"), "rep", "vector")
    ended = None
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.first("done").alias("__d"))
        sizes = materialize(sizes, fresh_path(spark, "nodes"))
        large = sizes.where(~F.col("__d") & (F.col("size") > LEAF)).select("node", "size")
        small = rows.join(sizes.where(F.col("__d") | (F.col("size") <= LEAF)).select("node", "size"), "node")
        small = small.select("node", "size", "rep", "vector")
        ended = small if ended is None else ended.unionAll(small)
        count = large.count()
        if not count:
            return ended
        # About NODE_SAMPLE vectors of each large node, chosen by hash.
        share = F.least(F.lit(1.0), F.lit(float(NODE_SAMPLE)) / F.col("size"))
        open_ = rows.join(large, "node")
        sample = open_.where(F.pmod(F.xxhash64("rep", "node"), F.lit(1 << 30)) < share * (1 << 30)).select("node", "size", "rep", "vector")
        fitted = sample.groupBy("node").applyInPandas(_fitted, "node string, model binary")
        fitted = materialize(fitted, fresh_path(spark, "models"))
        size = fitted.agg(F.sum(F.octet_length("model"))).first()[0]
        blocks = max(1, -(-size // (MODELS * MODEL_BYTES)))
        parts = None
        for k in range(blocks):
            own = F.pmod(F.xxhash64("node"), F.lit(blocks)) == k
            models = {r["node"]: bytes(r["model"]) for r in fitted.where(own).collect()}
            part = _routed(rows.join(large.where(own).select("node"), "node", "left_semi").select("node", "rep", "vector"), models)
            parts = part if parts is None else parts.unionAll(part)
        rows = materialize(parts, fresh_path(spark, "routed"))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a tile: between its two chunks, or within one if they are the same."""
    ids = pdf["rep"].to_numpy()
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chunk = pdf["chunk"].to_numpy()
    low, high = pdf["x"].iloc[0], pdf["y"].iloc[0]
    one, two = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    found_a, found_b = [], []
    for at in range(0, len(one), TILE):
        i, j = np.nonzero(x[one[at : at + TILE]] @ x[two].T >= COSINE)
        a, b = ids[one[at + i]], ids[two[j]]
        keep = a != b if low != high else a < b
        found_a.append(np.minimum(a, b)[keep])
        found_b.append(np.maximum(a, b)[keep])
    if not found_a:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    return pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})


def links(reps: DataFrame, trees: int | None = None) -> DataFrame:
    """Distinct (a, b), a < b, of different vectors with cosine of COSINE or more that share a leaf."""
    found = leaves(reps, trees or trees_for(reps.count()))
    chunks = F.ceil(F.col("size") / TILE).cast("int")
    placed = found.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("__n", chunks)
    tiles = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    tiles = tiles.select(
        "node", F.least("chunk", "__o").alias("x"), F.greatest("chunk", "__o").alias("y"), "chunk", "rep", "vector"
    )
    return tiles.groupBy("node", "x", "y").applyInPandas(_compare, LINKS).distinct()


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", trees: int | None = None) -> DataFrame:
    """(key, n_links, component_id) of every row."""
    spark = table.sparkSession
    v = F.col("vector")
    rows = table.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    usable = F.coalesce(
        (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    usable = usable & F.col("id").isNotNull()
    good = rows.where(usable)
    classes = good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, fresh_path(spark, "vectors"))
    found = materialize(links(classes.select("rep", "vector"), trees), fresh_path(spark, "links"))
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select("rep", "copies")
    partners = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("__n"))
    joined = components(found).withColumnsRenamed({"node": "rep", "component": "__c"})
    per_class = classes.join(partners.withColumnRenamed("a", "rep"), "rep", "left").join(joined, "rep", "left")
    per_class = per_class.select(
        "vector", (F.coalesce("__n", F.lit(0)) + F.col("copies") - 1).alias("__links"), F.coalesce("__c", "rep").alias("__component")
    )
    out = rows.withColumn("vector", F.when(usable, v)).join(per_class, "vector", "left")
    return out.select(
        F.col("id").alias(key), F.coalesce("__links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("__component", "id").alias("component_id")
    )
