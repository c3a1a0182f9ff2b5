"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded from its bytes and words, a small network
maps the encoding to a representation h, gated attention a ~ exp(w . (tanh(V h) * sigmoid(U h))) weighs the passages, and the
score is a logistic function of the weighted representation. All weights are learned together from document labels.

The model is fitted, in one task, on a bounded sample (TRAIN_DOCS labelled rows with the smallest key hashes, of TRAIN_TEXT bytes at most,
TRAIN_BYTES together; one text for an id that stands by several);
every passage of every whole text is scored. Attention logits are bounded, so a text of any length is pooled passage by passage.

Defined cases: null and empty texts score 0; labels other than 0 and 1, and keys with contradicting labels, are not learned from;
without labels of both kinds the score is the mean label (0.5 if none); equal texts score alike; all columns stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.text import SOLID_BYTES, flat, mix, pieces, positions, release, span_hashes, spans

TRAIN_DOCS, TRAIN_TEXT, TRAIN_BYTES = 3_000, 64 << 10, 64 << 20
PASSAGE_BYTES, PAIR_BINS, HIDDEN, GATE = 1024, 256, 32, 16
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.003, 1e-4
BYTE_BINS = 129
FEATURES = BYTE_BINS + PAIR_BINS + 5
PREDICTED_FROM = 0.3

_PAIRS = np.random.default_rng(11).integers(0, PAIR_BINS, 1 << 16, dtype=np.uint8)


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(encodings of all passages, text of each)."""
    sizes = np.diff(offsets)
    counts = -(-sizes // PASSAGE_BYTES)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = offsets[:-1][text] + positions(np.zeros(len(sizes), np.int64), counts) * PASSAGE_BYTES
    end = np.minimum(start + PASSAGE_BYTES, offsets[1:][text])
    n, length = len(text), (end - start).astype(np.float32)
    size = end - start  # texts are adjacent, so passages tile the bytes
    single = np.bincount(np.repeat(np.arange(n) * BYTE_BINS, size) + np.minimum(data, BYTE_BINS - 1), minlength=n * BYTE_BINS)
    single = single.reshape(n, BYTE_BINS).astype(np.float32)
    after = np.append(data[1:], 0)
    after[end - 1] = 0  # the last byte of a passage is paired with nothing
    both = _PAIRS[(data.astype(np.uint16) << 8) | after]
    pair = np.bincount(np.repeat(np.arange(n) * PAIR_BINS, size) + both, minlength=n * PAIR_BINS)
    pair = pair.reshape(n, PAIR_BINS).astype(np.float32)
    s, e, _ = spans(data, offsets, SOLID_BYTES)
    of = np.searchsorted(start, s, "right") - 1
    words = np.bincount(of, minlength=n).astype(np.float32)
    letters = np.bincount(of, weights=e - s, minlength=n).astype(np.float32)
    squares = np.bincount(of, weights=np.square(e - s, dtype=np.float64), minlength=n).astype(np.float32)
    seen = ~pd.Series(span_hashes(data, s, e) ^ mix(of.astype(np.uint64))).duplicated().to_numpy()
    distinct = np.bincount(of[seen], minlength=n).astype(np.float32)
    some = np.maximum(words, 1)
    mean = letters / some
    spread = np.sqrt(np.maximum(squares / some - mean * mean, 0))
    rest = [distinct / some, np.log1p(mean), np.log1p(spread), np.log1p(length), np.log1p(words)]
    return np.concatenate([np.sqrt(single / length[:, None]), np.sqrt(pair / length[:, None]), np.stack(rest, 1)], 1, dtype=np.float32), text


@dataclass
class Model:
    """Weights; ``constant`` takes the place of all of them where nothing could be learned."""

    constant: float | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _hidden(x: np.ndarray, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = np.tanh(x @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"] + m["v"]), _sigmoid(h @ m["U"] + m["u"])
    return h, t, s, np.exp((t * s) @ m["w"])


def _gradients(x: np.ndarray, begin: np.ndarray, y: np.ndarray, m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean log loss; ``begin`` has the first passage of each bag."""
    bag = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
    h, t, s, raised = _hidden(x, m)
    a = raised / np.add.reduceat(raised, begin)[bag]
    z = np.add.reduceat(a[:, None] * h, begin, axis=0)
    do = (_sigmoid(z @ m["c"] + m["c0"]) - y) / len(y)
    dz = do[:, None] * m["c"]
    da = (h * dz[bag]).sum(1)
    de = a * (da - np.add.reduceat(a * da, begin)[bag])
    dt, ds = de[:, None] * m["w"] * s * (1 - t * t), de[:, None] * m["w"] * t * s * (1 - s)
    dh = (a[:, None] * dz[bag] + dt @ m["V"].T + ds @ m["U"].T) * (1 - h * h)
    return {
        "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ ds, "u": ds.sum(0),
        "w": (t * s).T @ de, "c": z.T @ do, "c0": do.sum(),
    }


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """Learn from whole texts and their 0/1 labels, by Adam on batches of documents."""
    data, offsets = flat(texts)
    some = np.flatnonzero(np.diff(offsets))
    labels = labels[some].astype(np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(constant=float(labels.mean()) if len(labels) else 0.5)
    blocks = [passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
    x = np.concatenate([b[0] for b in blocks])
    counts = np.concatenate([np.bincount(t, minlength=b - a) for (_, t), (a, b) in zip(blocks, pieces(offsets), strict=True)])[some]
    first = np.cumsum(counts) - counts
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    shape = {"W": (FEATURES, HIDDEN), "b": HIDDEN, "V": (HIDDEN, GATE), "v": GATE, "U": (HIDDEN, GATE), "u": GATE, "w": GATE, "c": HIDDEN, "c0": ()}
    m = {k: np.float32(rng.normal(0, 1 / np.sqrt(s[0]) if isinstance(s, tuple) and s else 0.1, s)) for k, s in shape.items()}
    m["c0"] = np.float32(np.log(labels.mean() / (1 - labels.mean())))
    one, two = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            size = counts[bags]
            g = _gradients(x[positions(first[bags], size)], np.cumsum(size) - size, labels[bags], m)
            step += 1
            for k in m:
                g[k] = g[k] + DECAY * m[k]
                one[k] = 0.9 * one[k] + 0.1 * g[k]
                two[k] = 0.999 * two[k] + 0.001 * g[k] ** 2
                m[k] = m[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean=mean, scale=scale, weights=m)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    data, offsets = flat(texts)
    out = np.zeros(len(texts))
    some = np.diff(offsets) > 0
    if model.constant is not None:
        return np.where(some, model.constant, 0.0)
    m, scale, mean = model.weights, model.scale.astype(np.float32), model.mean.astype(np.float32)
    for a, b in pieces(offsets, 1 << 20):
        if offsets[a] == offsets[b]:
            continue
        top, bottom = np.zeros(b - a), np.zeros(b - a)
        # A text beyond the piece size comes alone and is cut into runs of whole passages.
        for lo in range(int(offsets[a]), int(offsets[b]), PASSAGE_BYTES << 10):
            hi = min(lo + (PASSAGE_BYTES << 10), int(offsets[b]))
            if b - a > 1:
                lo, hi = int(offsets[a]), int(offsets[b])
            x, text = passages(data[lo:hi], np.clip(offsets[a : b + 1], lo, hi) - lo)
            h, _, _, raised = _hidden((x - mean) / scale, m)
            np.add.at(top, text, raised * (h @ m["c"]))
            np.add.at(bottom, text, raised)
            if b - a > 1:
                break
        out[a:b] = np.where(bottom > 0, _sigmoid(top / np.maximum(bottom, 1e-300) + m["c0"]), 0.0)
    return out


def is_held_out(key: str) -> Column:
    """A fifth of the keys, whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the rows (key, label, text), taken in order up to TRAIN_BYTES; one task fits, the driver gets the weights."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        fits = int(np.searchsorted(size + np.cumsum(sizes), TRAIN_BYTES, "right"))
        held.append(batch.slice(0, fits))
        size += int(sizes[:fits].sum())
        if fits < batch.num_rows:
            break
    if not held:
        held = [pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.string())], ["key", "label", "text"])]
    sample = pa.Table.from_batches(held).sort_by([("key", "ascending"), ("text", "ascending")])
    model = fit(sample["text"].combine_chunks(), sample["label"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
    release()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on about TRAIN_DOCS labelled rows, or all if there are fewer: those first by a hash of id and text, 2 * TRAIN_DOCS rows and
    TRAIN_BYTES at most. At most 2 * TRAIN_DOCS keys are broadcast."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(key)).select(key, label)
    share = min(1.0, TRAIN_DOCS / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) <= int(share * (1 << 40)))
    marked = marked.groupBy(key).agg(F.min(label).alias("__low"), F.max(label).alias("__high")).where("__low = __high")
    marked = marked.orderBy(F.xxhash64(key), key).limit(2 * TRAIN_DOCS)
    rows = docs.select(key, F.col(text).alias("__text")).where(F.octet_length("__text") <= TRAIN_TEXT)
    sample = rows.join(F.broadcast(marked), key)
    sample = sample.select(F.col(key).cast("bigint").alias("key"), F.col("__low").cast("int").alias("label"), F.col("__text").alias("text"))
    # A key that holds very many rows is one row a task before it is shuffled.
    sample = sample.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    ordered = sample.orderBy(F.xxhash64("key"), "key").limit(2 * TRAIN_DOCS)
    found = ordered.coalesce(1).mapInArrow(_fitted, "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else fit(pa.array([], pa.string()), np.empty(0, np.int32))


def scored(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """Documents with the score of their whole text as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(score_texts(texts, shared.value))
            release()

    return docs.withColumn(name, score(F.col(text)))


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that score PREDICTED_FROM or more; columns as before."""
    name = "__quality_score"
    return scored(docs, train(docs, labels, **options), name).where(F.col(name) >= PREDICTED_FROM).drop(name)
