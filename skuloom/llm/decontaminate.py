"""Benchmark decontamination: suffix arrays over shards of the corpus, searched for every benchmark suffix.

Each task cuts its texts into words (A-Z lower-cased, letters, digits and everything beyond ASCII), builds the
suffix array of a shard of words and finds, by binary search, where each suffix of each benchmark item occurs with a whole
window of words. Matches are then followed to their full length and compared byte by byte.

Defined cases: null and empty texts have no words and no matches; items without words never match; an item of fewer words
than the window must occur whole; equal items share their matches, and each id is listed once (a null id as
"null"); repeated documents are judged alike; an empty benchmark leaves everything clean. All columns of the documents stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.suffixes import search, suffix_array
from skuloom.llm.text import LOWER, WORD_BYTES, flat, pieces, positions, release, span_hashes, spans

WINDOW = 13
#: Benchmark bytes broadcast at once; a larger benchmark is searched in several such blocks.
BLOCK_BYTES = 32 << 20
SHARD_WORDS = 1 << 20
#: Text whose suffixes are sorted at once; its words and arrays take some thirty times as much.
TEXT_BYTES = 1 << 20
MATCHES = "array<struct<doc_word:int,n_words:int,item_word:int,item_ids:array<string>>>"
_MATCH = pa.struct(
    [("doc_word", pa.int32()), ("n_words", pa.int32()), ("item_word", pa.int32()), ("item_ids", pa.list_(pa.string()))]
)
_FOUND = pa.struct([("n_words", pa.int64()), ("matches", pa.list_(_MATCH))])


class Words:
    """Words of a batch of texts: 64-bit hashes with a 0 after each text, and where the bytes are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, pad: int) -> None:
        self.data = LOWER[data]
        self.starts, self.ends, before = spans(self.data, offsets, WORD_BYTES)
        n = len(offsets) - 1
        self.counts = np.diff(before)
        self.first = before[:-1] + np.arange(n)  # place of each text's first word among words and separators
        self.shift = np.repeat(np.arange(n), self.counts)
        self.hashes = np.zeros(len(self.starts) + n + pad, np.uint64)
        self.hashes[np.arange(len(self.starts)) + self.shift] = np.maximum(span_hashes(self.data, self.starts, self.ends), 1)

    def words(self, text: int, at: int, n: int) -> list[bytes]:
        i = int(self.first[text]) - text + at
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[i : i + n], self.ends[i : i + n], strict=True)]


class Suffixes:
    """The suffixes of benchmark items that begin a window, equal items taken together."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window = window
        texts = pa.array([t for _, t in items], pa.large_string())
        self.of = Words(*flat(texts), window)
        ids: dict[tuple[bytes, ...], list[str]] = {}
        index: dict[tuple[bytes, ...], int] = {}
        for i, (name, _) in enumerate(items):
            own = tuple(self.of.words(i, 0, int(self.of.counts[i])))
            if own:
                ids.setdefault(own, []).append(name)
                index.setdefault(own, i)
        self.item_ids = [sorted(set(ids[w])) for w in index]
        self.text = np.array(list(index.values()), np.int64)
        sizes = np.array([len(w) for w in index], np.int64)
        windows = np.maximum(sizes - window + 1, 1)
        self.item = np.repeat(np.arange(len(sizes)), windows)
        self.at = positions(np.zeros(len(sizes), np.int64), windows)
        self.left = sizes[self.item] - self.at
        self.need = np.minimum(self.left, window)
        self.place = self.of.first[self.text][self.item] + self.at if len(sizes) else np.empty(0, np.int64)


def matches(words: Words, of: Suffixes) -> list[tuple[int, int, int, int, int]]:
    """(text, its word, words matched, item, word of the item) of every longest verbatim match of a window or more."""
    found = []
    if not len(of.place):
        return found
    total, hashes = len(words.hashes) - of.window, words.hashes
    for lo in range(0, total, SHARD_WORDS):
        array = suffix_array(hashes, lo, min(lo + SHARD_WORDS, total), of.window)
        low, high = search(array, hashes, of.of.hashes, of.place, of.need)
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        doc = array[positions(low, counts)]
        # A match that the word before prolongs is found from there.
        at = of.place[which]
        left = (of.at[which] > 0) & (doc > 0)
        begins = ~left | (hashes[doc - 1] != of.of.hashes[at - 1])
        which, doc, at = which[begins], doc[begins], at[begins]
        size = of.need[which].copy()
        going = np.flatnonzero(size < of.left[which])
        while len(going):
            same = hashes[doc[going] + size[going]] == of.of.hashes[at[going] + size[going]]
            going = going[same]
            size[going] += 1
            going = going[size[going] < of.left[which[going]]]
        text = np.searchsorted(words.first, doc, "right") - 1
        start = doc - words.first[text]
        for t, s, n, w in zip(text.tolist(), start.tolist(), size.tolist(), which.tolist(), strict=True):
            item = int(of.item[w])
            if words.words(t, s, n) == of.of.words(int(of.text[item]), int(of.at[w]), n):
                found.append((t, s, n, item, int(of.at[w])))
    return found


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> list[Broadcast]:
    """The benchmark in blocks of about ``block_bytes``, each collected and broadcast by itself."""
    spark = benchmark.sparkSession
    rows = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return [
        spark.sparkContext.broadcast(Suffixes(sorted((r[0], r[1]) for r in rows.where(block == k).collect()), window))
        for k in range(n)
    ]


def _finder(block: Broadcast):
    @F.arrow_udf(f"struct<n_words:bigint,matches:{MATCHES}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of: Suffixes = block.value
        for texts in batches:
            data, offsets = flat(texts)
            counts, found = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
            for a, b in pieces(offsets, TEXT_BYTES):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], of.window)
                counts[a:b] = words.counts
                for t, s, n, item, at in matches(words, of):
                    found[a + t].append((s, n, at, of.item_ids[item]))
            rows = [
                {"n_words": n, "matches": [dict(zip(_MATCH.names, m, strict=True)) for m in sorted(own)]}
                for n, own in zip(counts.tolist(), found, strict=True)
            ]
            yield pa.array(rows, _FOUND)
            release()

    return find


def covered_words(found: Column) -> Column:
    """Words inside any of the matches, which are in order of their first word."""
    end = lambda m: m["doc_word"] + m["n_words"]
    return F.aggregate(
        found,
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, m: F.struct(
            F.greatest(acc["upto"], end(m)).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), end(m) - F.greatest(acc["upto"], m["doc_word"]))).alias("n"),
        ),
    )["n"]


def match_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str = "contamination",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents with a column ``name``: n_words, n_hit (words inside matches), item_ids, matches."""
    blocks = _blocks(benchmark, item_id, item_text, window, block_bytes)
    out, parts = docs, []
    for k, block in enumerate(blocks):
        parts.append(f"__{name}_{k}")
        out = out.withColumn(parts[-1], _finder(block)(F.col(text)))
    found = F.col(parts[0])["matches"] if len(parts) == 1 else F.sort_array(F.concat(*[F.col(p)["matches"] for p in parts]))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda m: m["item_ids"]))))
    whole = F.struct(
        F.col(parts[0])["n_words"].alias("n_words"), covered_words(found).alias("n_hit"), ids.alias("item_ids"), found.alias("matches")
    )
    return out.withColumn(name, whole).drop(*parts)


def is_contaminated(found: Column) -> Column:
    """A twentieth of the words or more lies inside matches."""
    return (found["n_hit"] > 0) & (found["n_hit"] * 20 >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that are contaminated; columns as before."""
    name = "__contamination"
    return match_benchmark(docs, benchmark, name, **options).where(~is_contaminated(F.col(name))).drop(name)
