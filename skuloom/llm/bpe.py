"""Byte-level BPE of whole batches: every distinct pre-token of a batch is encoded once by the library."""

from __future__ import annotations

import os
from functools import cache
from itertools import chain, compress

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from skuloom.llm.text import distinct_spans, flat, pieces, positions, pre_tokens

PIECE_BYTES = 4 << 20
CACHE_WORDS = 300_000
#: Words given to the library as one text: calls and results cost more than short words.
GROUP_WORDS = 64


class BatchEncoder:
    """Token ids of texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The model never looks across pre-tokens, so ids of a distinct pre-token are kept and reused; the cache is
    emptied when it is full. Texts with characters beyond the class table, or with the text of a
    special token, are passed to the library whole.
    """

    def __init__(self, name: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        # The vocabulary spells every byte as one character.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _entries(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self._clear()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            texts = [w.decode() for w in new]
            plain = [t[0] == " " and t[1:].isalpha() for t in texts]
            new = [*compress(new, plain), *(w for w, p in zip(new, plain, strict=True) if not p)]
            parts = [self._in_groups(list(compress(texts, plain))), self._one_by_one([t for t, p in zip(texts, plain, strict=True) if not p])]
            ids, sizes = (np.concatenate(c) for c in zip(*parts, strict=True))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.pool = np.concatenate([self.pool, ids])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _in_groups(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of words that are a space and letters: put one after the other they are cut again at the spaces.

        Every id stands for a known number of bytes, so the ids of a word end where its bytes do.
        """
        groups = ["".join(words[k : k + GROUP_WORDS]) for k in range(0, len(words), GROUP_WORDS)]
        ids, _ = self._one_by_one(groups)
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        upto = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(upto, ends)
        if len(words) and not (last[-1] < len(upto) and np.array_equal(upto[last], ends)):
            return self._one_by_one(words)
        return ids, np.diff(last, prepend=-1)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts of pre-tokens, pre-tokens before each text, entry of each, texts for the library) of texts with pre-tokens."""
        starts, ends, before, odd = pre_tokens(data, offsets)
        first, codes = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        entry = self._entries([raw[starts[i] : ends[i]] for i in first])[codes]
        for s in self.special:
            at = raw.find(s.encode())
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s.encode(), at + 1)
        return starts, before, entry, odd

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if not len(data):
            return [np.empty(0, np.uint32)] * (len(offsets) - 1)
        _, before, entry, odd = self.tokens(data, offsets)
        sizes = self.size[entry]
        ids = self.pool[positions(self.at[entry], sizes)]
        cuts = np.concatenate([[0], np.cumsum(sizes)])[before]
        return [
            self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()) if odd[i] else ids[cuts[i] : cuts[i + 1]]
            for i in range(len(offsets) - 1)
        ]

    def encode(self, texts: pa.Array):
        """Yield the ids of each text; null is empty."""
        data, offsets = flat(texts)
        for a, b in pieces(offsets, PIECE_BYTES):
            yield from self._piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@cache
def encoder(name: str) -> BatchEncoder:
    return BatchEncoder(name)
