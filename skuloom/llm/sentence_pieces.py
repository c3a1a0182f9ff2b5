"""SentencePiece BPE by suffix-array matching: index the text of a batch, find every piece in it, relax the edges.

Chunks that no piece can cross (a run of spaces with the word after it, a line end) are taken once per batch. Their
text is indexed by a suffix array, every piece of the vocabulary is located by binary search, and its occurrences become edges
(start, end, piece). Relaxing them in order of their end keeps, for each prefix of a chunk, the last piece of the prefix's encoding:
BPE encodings are closed under substrings, so an edge extends the best path of its start exactly if BPE, given
the text of the two pieces alone, leaves them apart. That test replays the merges of both pieces against those across.

Defined cases: null and empty texts have no ids and decode to empty; characters outside the vocabulary become byte pieces;
equal rows get equal ids; decoding gives every text back as it was (null as empty), but for the character U+2581, which the model
uses for the space and which comes back as one. All columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from skuloom.llm.suffixes import search, suffix_array
from skuloom.llm.text import distinct_spans, flat, pieces, positions, release

PIECE_BYTES, CACHE_CHUNKS, INDEX_CHARS = 1 << 20, 150_000, 1 << 17
DECODE_IDS = 1 << 18
SPACE, MARK = "▁", "▁".encode()
NORMAL, UNKNOWN, BYTE = 1, 2, 6
GAP = 0x110000  # between chunks, no character
NEVER = np.iinfo(np.int64).min // 2


class Vocabulary:
    """Pieces of a SentencePiece BPE model with the merges that make each of them; bounded by the model file.

    Symbols are the pieces that merging makes, then single characters of pieces that are no piece
    themselves; the last symbol stands for any other character.
    """

    def __init__(self, name: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(public_tokenizers.path(name), "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and without normalization are covered")
        score = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        spelled = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL
            else " ⁇ ".encode() if p.type == UNKNOWN else b""
            for p in model.pieces
        ]
        self.spelled_data = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        # Equal scores are equal ranks; larger is merged first.
        steps = {s: r for r, s in enumerate(sorted({s for s, _ in score.values()}))}
        texts = list(score) + sorted({c for p in score for c in p} - set(score))
        symbol = {t: k for k, t in enumerate(texts)}
        rank = [steps[score[t][0]] if t in score else -1 for t in texts]
        pairs = {}
        for t in score:
            for i in range(1, len(t)):
                if t[:i] in symbol and t[i:] in symbol:
                    pairs[symbol[t[:i]] << 32 | symbol[t[i:]]] = symbol[t]
        joins = {k: (rank[v], v) for k, v in pairs.items()}

        def merges(text: str) -> list[tuple[int, int, int]] | None:
            """(rank, first symbol, last symbol) after each merge, if ``text`` ends as one symbol."""
            own, out = [symbol[c] for c in text], []
            while len(own) > 1:
                found = [(joins[k][0], -i) for i, (a, b) in enumerate(zip(own, own[1:], strict=False)) if (k := a << 32 | b) in joins]
                if not found:
                    return None
                best, i = max(found)
                own[-i : -i + 2] = [joins[own[-i] << 32 | own[-i + 1]][1]]
                out.append((best, own[0], own[-1]))
            return out

        made = [merges(t) for t in texts]
        self.other = len(texts)
        n, most = len(texts) + 1, max(map(len, texts))
        self.rank_of = np.full((n, most + 1), NEVER, np.int64)  # rank of the k-th merge
        self.head = np.full((n, most + 1), self.other, np.int64)  # first and last symbol after k merges
        self.tail = self.head.copy()
        for s, (t, steps_of) in enumerate(zip(texts, made, strict=True)):
            if steps_of is not None:
                self.head[s, 0], self.tail[s, 0] = symbol[t[0]], symbol[t[-1]]
                for k, (r, a, b) in enumerate(steps_of):
                    self.rank_of[s, k], self.head[s, k + 1], self.tail[s, k + 1] = r, a, b
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = keys
        self.pair_rank = np.array([joins[k][0] for k in keys.tolist()], np.int64)
        self.id = np.array([score[t][1] if t in score else -1 for t in texts] + [-1], np.int64)
        # Needles: symbols of two characters or more that merging can make, and all single ones.
        use = [s for s, m in enumerate(made) if m is not None]
        self.needle = np.array(use, np.int64)
        self.size = np.array([len(texts[s]) for s in use], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.chars = np.frombuffer("".join(texts[s] for s in use).encode("utf-32-le"), np.uint32)
        self.depth = int(self.size.max())
        self.lines = not any("\n" in t for t in texts)

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of adjacent symbols as they are: no merge across is ever the best one."""
        out = np.ones(len(left), bool)
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        going = np.arange(len(left))
        while len(going):
            u, t = left[going], right[going]
            key = self.tail[u, i[going]] << 32 | self.head[t, j[going]]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, self.pair_rank[at], NEVER)
            own, next_ = self.rank_of[u, i[going]], self.rank_of[t, j[going]]
            # Of equal ranks the leftmost goes first.
            crossed = (across > own) & (across >= next_)
            out[going[crossed]] = False
            first = own >= next_
            done = crossed | ((own == NEVER) & (next_ == NEVER))
            i[going] += first
            j[going] += ~first
            going = going[~done]
        return out


@cache
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


class ChunkEncoder:
    """Ids of chunks, kept for the next batch; the store is emptied when it is full."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.pairs, self.verdict = np.empty(0, np.int64), np.empty(0, bool)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def forget(self) -> None:
        """Keep no chunks beyond a task: its process goes on to serve other operators."""
        self._clear()
        release()

    def _apart(self, keys: np.ndarray) -> np.ndarray:
        """Verdicts by key; each pair of symbols is replayed once."""
        at = np.searchsorted(self.pairs, keys)
        seen = at < len(self.pairs)
        seen[seen] = self.pairs[at[seen]] == keys[seen]
        if not seen.all():
            new = np.unique(keys[~seen])
            verdict = self.vocab.apart(new >> 32, new & 0xFFFFFFFF)
            if len(self.pairs) > 4_000_000:
                self.pairs, self.verdict = np.unique(keys[seen]), np.empty(0, bool)
                self.verdict = self.vocab.apart(self.pairs >> 32, self.pairs & 0xFFFFFFFF)
            into = np.searchsorted(self.pairs, new)
            self.pairs, self.verdict = np.insert(self.pairs, into, new), np.insert(self.verdict, into, verdict)
            at = np.searchsorted(self.pairs, keys)
        return self.verdict[at]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, how many each has)."""
        v = self.vocab
        texts = [w.decode().replace(" ", SPACE) for w in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lengths + 1) - lengths - 1
        n = int((lengths + 1).sum())
        chars = np.full(n + v.depth, GAP, np.uint32)
        body = positions(begin, lengths)
        chars[body] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        array = suffix_array(chars, 0, n, v.depth)
        low, high = search(array, chars, v.chars, v.place, v.size)
        counts = high - low
        start = array[positions(low, counts)]
        symbol, size = np.repeat(v.needle, counts), np.repeat(v.size, counts)
        found = np.zeros(n, bool)
        found[start[size == 1]] = True
        rest = body[~found[body]]  # characters outside the vocabulary
        start = np.concatenate([start, rest])
        symbol = np.concatenate([symbol, np.full(len(rest), v.other)])
        size = np.concatenate([size, np.ones(len(rest), np.int64)])
        word = np.repeat(np.arange(len(words)), lengths + 1)
        offset = start - begin[word[start]] + size
        order = np.argsort(offset, kind="stable")
        start, symbol, size = start[order], symbol[order], size[order]
        cuts = np.searchsorted(offset[order], np.arange(1, int(lengths.max(initial=0)) + 2))
        # last[p]: symbol that ends at position p of a chunk in the encoding of the chunk up to there.
        last = np.full(n + 1, -1, np.int64)
        step = np.zeros(n + 1, np.int64)
        head = np.zeros(n + 1, bool)
        head[begin] = True
        for a, b in zip(cuts, cuts[1:], strict=False):
            s, t, z = start[a:b], symbol[a:b], size[a:b]
            fits = head[s] | (last[s] >= 0)
            fits[fits] = head[s[fits]] | self._apart(np.maximum(last[s[fits]], 0) << 32 | t[fits])
            last[(s + z)[fits]], step[(s + z)[fits]] = t[fits], z[fits]
        used, at = [], begin + lengths
        going = np.flatnonzero(lengths > 0)
        while len(going):
            p = at[going]
            used.append(p)
            at[going] = p - step[p]
            going = going[at[going] > begin[going]]
        ends = np.sort(np.concatenate(used)) if used else np.empty(0, np.int64)
        symbols, owner = last[ends], word[np.maximum(ends - 1, 0)]
        ids = v.id[symbols]
        plain = ids >= 0
        if plain.all():
            return ids.astype(np.int32), np.bincount(owner, minlength=len(words))
        spelled = [np.frombuffer(chr(c).encode(), np.uint8) for c in chars[ends[~plain] - 1]]
        each = np.ones(len(ids), np.int64)
        each[~plain] = [len(x) for x in spelled]
        out = np.repeat(ids, each)
        out[out < 0] = v.byte_id[np.concatenate(spelled)]
        return out.astype(np.int32), np.bincount(np.repeat(owner, each), minlength=len(words))

    def entries(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_CHUNKS:
            self._clear()
        new = [w for w in words if w not in self.known]
        done, held = 0, 0
        for k, w in enumerate(new):
            held += len(w)
            if held >= INDEX_CHARS or k == len(new) - 1:
                ids, sizes = self._encode(new[done : k + 1])
                self.known.update(zip(new[done : k + 1], range(len(self.known), len(self.known) + k + 1 - done), strict=True))
                self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(sizes) - sizes])
                self.size, self.pool = np.concatenate([self.size, sizes]), np.concatenate([self.pool, ids])
                done, held = k + 1, 0
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def chunks(data: np.ndarray, offsets: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before each text, their offsets, starts, ends, chunks before each text)."""
    some = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[some], 0x20)
    shift = np.zeros(len(offsets), np.int64)
    shift[some + 1] = 1
    offsets = offsets + np.cumsum(shift)
    mark = np.zeros(len(data) + 1, bool)
    space = data == 0x20
    mark[1:-1] = space[1:] & ~space[:-1]
    own = np.zeros(len(data), bool)  # the last byte of a space mark in the text itself
    own[2:] = (data[2:] == MARK[2]) & (data[1:-1] == MARK[1]) & (data[:-2] == MARK[0])
    mark[1:-1] &= ~own[:-1]
    if lines:
        ends = np.flatnonzero(data == 0x0A)
        mark[ends] = True
        mark[ends + 1] = True
    mark[offsets] = True
    starts = np.flatnonzero(mark[:-1])
    return data, offsets, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def _encode_texts(coder: ChunkEncoder, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ids before each text) for runs of texts."""
    data, offsets = flat(texts)
    for a, b in pieces(offsets, PIECE_BYTES):
        own, _, starts, ends, before = chunks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], coder.vocab.lines)
        if not len(starts):
            yield np.empty(0, np.int32), np.zeros(b - a + 1, np.int64)
            continue
        first, codes = distinct_spans(own, starts, ends)
        raw = own.tobytes()
        entry = coder.entries([raw[starts[i] : ends[i]] for i in first])[codes]
        sizes = coder.size[entry]
        yield coder.pool[positions(coder.at[entry], sizes)], np.concatenate([[0], np.cumsum(sizes)])[before]


def _decode_ids(vocab: Vocabulary, ids: np.ndarray, before: np.ndarray) -> Iterator[str]:
    """Texts of consecutive lists of ids: pieces are joined, byte pieces read as UTF-8, the space before a text goes."""
    for a, b in pieces(before, DECODE_IDS):
        part = ids[before[a] : before[b]]
        sizes = vocab.spelled_size[part]
        raw = vocab.spelled_data[positions(vocab.spelled_at[part], sizes)].tobytes()
        cut = np.concatenate([[0], np.cumsum(sizes)])[before[a : b + 1] - before[a]].tolist()
        for s, e in zip(cut, cut[1:], strict=False):
            yield raw[s + (raw[s : s + 1] == b" ") : e].decode("utf-8", "replace")


def shared_vocabulary(spark: SparkSession, name: str) -> Broadcast:
    """Bounded by the model file."""
    return spark.sparkContext.broadcast(vocabulary(name))


def _listed(runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    out, cuts, total = [], [np.zeros(1, np.int64)], 0
    for own, before in runs:
        out.append(pa.array(own, pa.int32()))
        cuts.append(before[1:] + total)
        total += len(own)
    values = pa.concat_arrays(out) if out else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(cuts), pa.int32()), values)


def _slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts in runs of about PIECE_BYTES, so that ids and copies of a whole batch never stand beside it."""
    for texts in batches:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in pieces(np.concatenate([[0], np.cumsum(sizes)]), PIECE_BYTES):
            yield texts.slice(a, b - a)


_encoders: dict[str, ChunkEncoder] = {}


def encode(docs: DataFrame, name: str, text: str = "text", ids: str = "ids", checked: str | None = None) -> DataFrame:
    """Documents with the ids of their text as column ``ids``; ``name`` is a public SentencePiece model.

    ``checked`` names a column that says whether the ids, decoded again in the same task, give the text.
    """
    shared = shared_vocabulary(docs.sparkSession, name)

    def own_coder() -> ChunkEncoder:
        return _encoders.get(name) or _encoders.setdefault(name, ChunkEncoder(shared.value))

    if checked is None:

        @F.arrow_udf("array<int>")
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in _slices(batches):
                yield _listed(_encode_texts(own_coder(), texts))
                release()
            own_coder().forget()

        return docs.withColumn(ids, encoded(F.col(text)))

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _slices(batches):
            lists, same = _listed(_encode_texts(own_coder(), texts)), []
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            for t, back in zip(texts, _decode_ids(shared.value, values, at), strict=True):
                same.append(back == (t.as_py() or ""))
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "same"])
            del lists, values
            release()
        own_coder().forget()

    found = F.col("__encoded")
    return docs.withColumn("__encoded", both(F.col(text))).withColumns({ids: found["ids"], checked: found["same"]}).drop("__encoded")


def decoded(spark: SparkSession, ids: Column, name: str) -> Column:
    """Text of an array of ids; null is empty."""
    shared = shared_vocabulary(spark, name)

    @F.arrow_udf("string")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            before = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            values = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.array(_decode_ids(shared.value, values, before.astype(np.int64)), pa.string())

    return joined(ids)
