"""Token counts that follow edits: a segment tree of pre-tokens per document, re-encoded only where an edit reaches.

The leaves of a tree are runs of LEAF_TOKENS pre-tokens with their bytes and tokens; its inner nodes hold sums. An edit descends by
byte sums to its place, re-encodes the leaves it touches with two pre-tokens of context before, goes on until an old leaf
boundary is a pre-token boundary again (from there on the pattern sees the same text), and updates the sums above. Leaves are
what is stored between batches of edits: inner nodes follow from them.

Edits are (start, n, text): replace ``n`` characters from ``start`` (0-based, in the text as edited so far) by ``text``.

Defined cases: null and empty texts have no leaves and no tokens, and can be edited; null parts of an edit count as 0 and
empty; places beyond the end are the end; documents without edits keep their counts; edits of unknown documents are ignored; edits of a
null key are ignored; rows that share a key all get its edits. All columns of the documents stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.bpe import BatchEncoder, encoder
from skuloom.llm.text import flat, pieces, pre_tokens, release

LEAF_TOKENS, CONTEXT = 64, 2
TREE = "struct<leaf_bytes:array<int>,leaf_tokens:array<int>>"
EDITED = "struct<text:string,leaf_bytes:array<int>,leaf_tokens:array<int>,reencoded_bytes:bigint>"
EDITS = "array<struct<start:int,n:int,text:string>>"


def _leaves(coder: BatchEncoder, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
    """(bytes, tokens) of the leaves of each text. A text for the library is one leaf."""
    if not len(data):
        yield from (([], []) for _ in range(len(offsets) - 1))
        return
    starts, before, entry, odd = coder.tokens(data, offsets)
    sums = np.concatenate([[0], np.cumsum(coder.size[entry])])
    edges = np.append(starts, len(data))
    for i in range(len(offsets) - 1):
        if odd[i]:
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            yield [len(raw)], [len(coder.whole(raw.decode()))]
        else:
            cut = np.append(np.arange(before[i], before[i + 1], LEAF_TOKENS), before[i + 1])
            yield np.diff(edges[cut]).tolist(), np.diff(sums[cut]).tolist()


class Tree:
    """Text of one document with the sums of its leaves."""

    def __init__(self, coder: BatchEncoder, raw: bytes, leaf_bytes: list[int], leaf_tokens: list[int]) -> None:
        self.coder, self.raw = coder, raw
        self.bytes, self.tokens = list(leaf_bytes), list(leaf_tokens)
        self.reencoded = 0
        self._build()

    def _build(self) -> None:
        """Inner nodes: node i has the children 2i and 2i + 1, leaf k is node size + k."""
        self.size = 1 << max(0, (len(self.bytes) - 1).bit_length())
        pad = [0] * (self.size - len(self.bytes))
        self.sum_bytes, self.sum_tokens = [0] * self.size + self.bytes + pad, [0] * self.size + self.tokens + pad
        for i in range(self.size - 1, 0, -1):
            self.sum_bytes[i] = self.sum_bytes[2 * i] + self.sum_bytes[2 * i + 1]
            self.sum_tokens[i] = self.sum_tokens[2 * i] + self.sum_tokens[2 * i + 1]

    def total(self) -> int:
        return self.sum_tokens[1] if self.bytes else 0

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf that holds byte ``place``, its first byte); the last leaf for the end."""
        node, first = 1, 0
        while node < self.size:
            node *= 2
            if place - first >= self.sum_bytes[node] and node + 1 < 2 * self.size and self.sum_bytes[node + 1]:
                first += self.sum_bytes[node]
                node += 1
        return node - self.size, first

    def _update(self, leaf: int, n: int, tokens: int) -> None:
        self.bytes[leaf], self.tokens[leaf] = n, tokens
        i = self.size + leaf
        more_bytes, more_tokens = n - self.sum_bytes[i], tokens - self.sum_tokens[i]
        while i:
            self.sum_bytes[i] += more_bytes
            self.sum_tokens[i] += more_tokens
            i //= 2

    def _starts(self, raw: bytes) -> np.ndarray:
        return pre_tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    def edit(self, place: int, n: int, new: bytes) -> None:
        """Replace ``n`` bytes from ``place`` on."""
        old, self.raw = self.raw, self.raw[:place] + new + self.raw[place + n :]
        grown = len(new) - n
        if not self.bytes or len(self.bytes) == 1:
            return self._again(0, len(self.bytes), 0, len(self.raw))
        low, first = self._leaf_at(max(0, place - 1))
        # Pre-tokens end where they do because of the text up to two pre-tokens on.
        while low and self._starts(old[first:place]).size <= CONTEXT:
            low -= 1
            first -= self.bytes[low]
        high, end = self._leaf_at(place + n)
        end += self.bytes[high]
        while True:
            # The next leaves are context: is their beginning a pre-token boundary still?
            after = sum(self.bytes[high + 1 : high + 2 + CONTEXT])
            part = np.frombuffer(self.raw[first : end + grown + after], np.uint8)
            if not len(part):
                return self._again(low, high + 1, first, end + grown)
            starts, _, _, odd = self.coder.tokens(part, np.array([0, len(part)]))
            if odd[0]:
                return self._again(0, len(self.bytes), 0, len(self.raw))
            if not after or end + grown - first in starts or end + grown == first:
                return self._again(low, high + 1, first, end + grown, after)
            high, end = high + 1, end + self.bytes[high + 1]

    def _again(self, low: int, high: int, first: int, end: int, after: int = 0) -> None:
        """Leaves low..high-1 now are the text from byte ``first`` to ``end``, where a pre-token ends given ``after`` bytes more."""
        self.reencoded += end - first
        part = np.frombuffer(self.raw[first : end + after], np.uint8)
        if after and end > first:
            starts, _, entry, _ = self.coder.tokens(part, np.array([0, len(part)]))
            own = int(np.searchsorted(starts, end - first))
            edges, sums = np.append(starts[:own], end - first), np.concatenate([[0], np.cumsum(self.coder.size[entry[:own]])])
            cut = np.append(np.arange(0, own, LEAF_TOKENS), own)
            n, tokens = np.diff(edges[cut]).tolist(), np.diff(sums[cut]).tolist()
        else:
            n, tokens = next(_leaves(self.coder, part[: end - first], np.array([0, end - first])))
        if len(n) == high - low:
            for k in range(len(n)):
                self._update(low + k, n[k], tokens[k])
        else:
            self.bytes[low:high], self.tokens[low:high] = n, tokens
            self._build()


def counted(docs: DataFrame, name: str, text: str = "text", tree: str = "tree") -> DataFrame:
    """Documents with the leaves of their token-count tree as column ``tree``; ``name`` is a public byte-level BPE."""

    @F.arrow_udf(TREE)
    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = flat(texts)
            found = []
            for a, b in pieces(offsets):
                found.extend(_leaves(encoder(name), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.StructArray.from_arrays(lists, ["leaf_bytes", "leaf_tokens"])
            release()

    return docs.withColumn(tree, build(F.col(text)))


def total(tree: str) -> Column:
    """Tokens of a document: the sum at the root."""
    return F.aggregate(F.col(tree)["leaf_tokens"], F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def applied(trees: DataFrame, name: str, edits: str = "edits", text: str = "text", tree: str = "tree", cost: str = "reencoded_bytes") -> DataFrame:
    """``text`` and ``tree`` after the edits of column ``edits``, in their order; ``cost`` has the bytes encoded for it."""

    @F.arrow_udf(EDITED)
    def edited(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, kept, changes in batches:
            out = []
            for t, k, changes_of in zip(texts.to_pylist(), kept.to_pylist(), changes.to_pylist(), strict=True):
                if not changes_of:
                    out.append(None)
                    continue
                own = Tree(encoder(name), (t or "").encode(), k["leaf_bytes"], k["leaf_tokens"])
                now = t or ""
                for e in changes_of:
                    start = min(max(0, e["start"] or 0), len(now))
                    n, new = max(0, e["n"] or 0), e["text"] or ""
                    own.edit(len(now[:start].encode()), len(now[start : start + n].encode()), new.encode())
                    now = now[:start] + new + now[start + n :]
                out.append({"text": now, "leaf_bytes": own.bytes, "leaf_tokens": own.tokens, "reencoded_bytes": own.reencoded})
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
            yield pa.array(out, pa.struct(list(zip(["text", "leaf_bytes", "leaf_tokens", "reencoded_bytes"], kinds, strict=True))))

    some = F.size(F.coalesce(F.col(edits), F.array().cast(EDITS))) > 0
    result = edited(F.when(some, F.col(text)), F.when(some, F.col(tree)), F.col(edits).cast(EDITS))
    new = trees.withColumn("__edited", result)
    after = F.col("__edited")
    return new.withColumns(
        {
            text: F.when(after.isNotNull(), after["text"]).otherwise(F.col(text)),
            tree: F.when(after.isNotNull(), F.struct(after["leaf_bytes"].alias("leaf_bytes"), after["leaf_tokens"].alias("leaf_tokens"))).otherwise(F.col(tree)),
            cost: F.coalesce(after["reencoded_bytes"], F.lit(0).cast("bigint")),
        }
    ).drop("__edited")


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id", order: str = "seq", name: str = "edits") -> DataFrame:
    """Documents with their rows of an edit table (key, ``order``, start, n, text) as one array column.

    A document's edits are bounded by what one row can hold, as its text is.
    """
    one = F.struct(F.col(order).alias("seq"), F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"), F.col("text").alias("text"))
    listed = edits.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_list(one)).alias("__edits"))
    fields = F.transform("__edits", lambda e: F.struct(e["start"].alias("start"), e["n"].alias("n"), e["text"].alias("text")))
    return docs.join(listed, docs[key] == F.col("__key"), "left").withColumn(name, fields).drop("__key", "__edits")


#: Personal data of plain shapes, by what takes its place.
PERSONAL = {
    "<EMAIL>": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "<IP>": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])",
    "<PHONE>": r"(?<!\w)\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]\d{2,4}){1,3}(?!\w)",
}


def redactions(docs: DataFrame, text: str = "text", patterns: dict[str, str] = PERSONAL, name: str = "edits") -> DataFrame:
    """Documents with the edits that put a mark in the place of each match; last match first, so that places stay true."""
    joined = re.compile("|".join(f"({p})" for p in patterns.values()))
    marks = list(patterns)

    @F.arrow_udf(EDITS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("text", pa.string())]))
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                hits = [(m.start(), m.end() - m.start(), marks[m.lastindex - 1]) for m in joined.finditer(t or "")]
                out.append([{"start": s, "n": n, "text": x} for s, n, x in reversed(hits)])
            yield pa.array(out, kind)

    return docs.withColumn(name, found(F.col(text)))
