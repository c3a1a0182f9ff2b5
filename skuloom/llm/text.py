"""Texts of an Arrow batch as one flat byte array: spans, hashes of spans, distinct spans, BPE pre-tokens.

Everything here runs inside tasks on one batch. Both word definitions of the contracts cut at ASCII
bytes only, and no byte of a longer UTF-8 character is below 0x80, so bytes can be cut instead of characters.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTES = np.arange(256)
# Letters and digits after lower-casing, and every byte of a character beyond ASCII.
WORD_BYTES = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
# All but the six ASCII white-space characters.
SOLID_BYTES = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))

_TABLE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def release() -> None:
    """Give freed memory back to the system between batches, where the C library can: executors are shared."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an Arrow string array; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of spans before each text) of the maximal runs of ``inside`` bytes within a text."""
    flag = inside[data]
    first, last = flag.copy(), flag.copy()
    first[1:] &= ~flag[:-1]
    last[:-1] &= ~flag[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = flag[cut]
    last[cut - 1] = flag[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, out=out)

    return run(_BASE), run(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all others (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """64-bit hash of every span; ``starts`` ascend and spans do not overlap."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(1 << max(20, (hi - lo).bit_length()))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_TABLE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def positions(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of ``start, start + 1, ...`` for every (start, size)."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a span of each distinct text, class of every span). Hashes group, bytes decide."""
    codes, uniques = pd.factorize(span_hashes(data, starts, ends))
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    sizes = ends - starts
    same = True
    for k in range(0, len(codes), 1 << 16):
        own, of = slice(k, k + (1 << 16)), first[codes[k : k + (1 << 16)]]
        at = positions(starts[own], sizes[own])
        same &= bool((sizes[own] == sizes[of]).all())
        same = same and bool((data[at] == data[at + np.repeat(starts[of] - starts[own], sizes[own])]).all())
    if not same:  # two texts share a hash: compare the texts themselves
        codes, uniques = pd.factorize(np.array([data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], object))
        first = np.empty(len(uniques), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first, codes


LETTER, NUMBER, OTHER, SPACE, ODD = range(5)
# Code points with the Unicode property White_Space beyond ASCII.
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    """Class of every code point; ODD marks those on which Unicode versions may differ."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, ODD, np.uint8)
    for cp in range(0x3000):
        category = unicodedata.category(chr(cp))
        out[cp] = ODD if category == "Cn" else kind.get(category[0], OTHER)
    out[[0x20, *range(0x09, 0x0E), *WIDE_SPACES]] = SPACE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = _classes()
    out = table[:256][data]
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        at = np.flatnonzero((data >= low) & (data < high))
        if len(at):
            cp = (data[at] & (0x3F >> more)).astype(np.int64)
            for k in range(1, more + 1):
                cp = (cp << 6) | (data[at + k] & 0x3F)
            found = table[np.minimum(cp, 0x10FFFF)]
            for k in range(more + 1):
                out[at + k] = found
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, tokens before each text, texts to be left to the library) of the byte-level BPE pattern

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, found from runs
    of one character class instead of by a regular expression. Tokens tile the texts.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(len(offsets) - 1, bool)
    kind = byte_classes(data)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    mark = np.ones(n, bool)
    mark[1:] = kind[1:] != kind[:-1]
    mark |= text_start[:n]
    runs = np.flatnonzero(mark)
    ends = np.append(runs[1:], n)
    followed = ~text_start[ends]
    of = kind[runs]

    white = (of == SPACE) & followed
    joined = white & (data[ends - 1] == 0x20)
    mark[ends[joined]] = False
    mark[ends[joined] - 1] = True
    apart = ends[white & ~joined] - 1
    while len(apart) and (late := (data[apart] & 0xC0) == 0x80).any():  # back to the first byte of the character
        apart = apart - late
    mark[apart] = True

    quote = (of == OTHER) & (ends - runs == 1) & (data[runs] == 0x27) & followed
    quote[1:] &= ~joined[:-1]
    at = np.flatnonzero(quote)
    if len(at):
        at = at[of[at + 1] == LETTER]
        p, stop = runs[at], ends[at + 1]
        one = data[p + 1]
        two = np.where(stop - p > 2, data[np.minimum(p + 2, n - 1)], 0)
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = short | long
        p, stop, size = p[hit], stop[hit], np.where(short[hit], 2, 3)
        mark[p + 1] = False
        rest = p + size < stop
        mark[(p + size)[rest]] = True

    starts = np.flatnonzero(mark)
    odd = np.zeros(len(offsets) - 1, bool)
    strange = np.flatnonzero(kind == ODD)
    if len(strange):
        odd[np.unique(np.searchsorted(offsets, strange, "right") - 1)] = True
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets), odd
