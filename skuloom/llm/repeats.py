"""Quality rules on repetition: maximal repeated runs of words in each text, from its suffix array.

The words of a text are ranked by doubling prefixes; the ranks of every doubling also give the longest common prefix of
neighbours in suffix order. An interval of that array whose values do not fall below L is a run of L words that occurs as often as
the interval has members; it is maximal if the words before its members differ. The places of all repeats of a least
size are united; a text fails if they cover too much of it or one of them is too long.

Defined cases: a null text has no words, an empty text too; both fail the base rules (under 50 words). Rows that share an id are
measured one by one. Overlapping places of a repeat (a line repeated without end) count once. Columns of the input stay; the
measures come as one struct column whose name the caller chooses.

A text is worked on whole: 4 bytes a word for each doubling, of which there are log2(longest repeat) + 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuloom.llm.text import SOLID_BYTES, distinct_spans, flat, pieces, release, spans

#: Base rules: words at least, and percent of words in repeated windows of WINDOW words at most.
MIN_WORDS, WINDOW, BASE_PERCENT = 50, 3, 50
#: Verdict: repeats of at least this many words count; they cover at most so many percent of the words, none is longer than the last.
REPEAT_WORDS, COVERED_PERCENT, LONGEST_WORDS = 8, 30, 200

_CODES = np.arange(256)
_SYMBOLS = np.isin(_CODES, list(b"#*$%&|<>"))
_NOT_NEWLINE = _CODES != 0x0A
_FIRST_BYTES = (_CODES & 0xC0) != 0x80

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "covered_words bigint, longest_repeat bigint, spans array<struct<begin:int,size:int>>"
)
REPEATS = "array<struct<begin:int,size:int,times:int>>"


class Suffixes:
    """Suffix order and common prefixes of many texts at once; ``text`` numbers the text of each word, ascending."""

    def __init__(self, codes: np.ndarray, text: np.ndarray) -> None:
        n = len(codes)
        self.text = text
        stop = np.searchsorted(text, text, "right")  # end of the own text
        key = text.astype(np.int64) * (int(codes.max()) + 1 if n else 1) + codes
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.empty(0, np.int64)
        rank = np.empty(n, np.int32)
        rank[order] = group
        levels, size = [rank], 1
        while True:
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            at = order[slots]
            later = np.minimum(at + size, n - 1)
            second = np.where(at + size < stop[at], rank[later], -1)
            by = np.lexsort((second, rank[at]))
            at, second = at[by], second[by]
            order[slots] = at
            first = rank[at]
            new = np.ones(len(at), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            fresh[slots] = new
            rank = rank.copy()
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            levels.append(rank)
            size *= 2
        self.order = order
        self.common = self._common(levels, stop)

    def _common(self, levels: list[np.ndarray], stop: np.ndarray) -> np.ndarray:
        """Words that each suffix shares with the one before it in order."""
        out = np.zeros(len(self.order), np.int64)
        if len(self.order) < 2:
            return out
        a, b = self.order[:-1], self.order[1:]
        slots = np.flatnonzero(levels[0][a] == levels[0][b])
        a, b = a[slots], b[slots]
        found = np.zeros(len(slots), np.int64)
        last = len(stop) - 1
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + found, b + found
            same = (x < stop[a]) & (y < stop[b])
            same &= levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)]
            found[same] += 1 << k
        out[slots + 1] = found
        return out

    def longest(self) -> np.ndarray:
        """For every word, the longest run from it on that occurs elsewhere in its text."""
        out = np.zeros(len(self.order), np.int64)
        np.maximum.at(out, self.order, self.common)
        np.maximum.at(out, self.order[:-1], self.common[1:])
        return out

    def maximal(self, codes: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        """(first place, words, places) of every maximal repeat of ``least`` words or more."""
        starts = np.searchsorted(self.text, self.text)
        before = np.where(np.arange(len(codes)) > starts, codes[np.maximum(np.arange(len(codes)) - 1, 0)], -1)
        # Two texts' starts never meet: an interval lies within one text. -1 (start of the text) occurs once in it.
        mixed = -2
        high = np.flatnonzero(self.common >= least)
        if not len(high):
            return
        cuts = np.flatnonzero(np.diff(high) > 1) + 1
        for run in np.split(high, cuts):
            slots = range(int(run[0]), int(run[-1]) + 1)
            lengths, places = self.common[run].tolist(), self.order[run[0] - 1 : run[-1] + 1].tolist()
            left = before[self.order[run[0] - 1 : run[-1] + 1]].tolist()
            open_: list[list[int]] = []  # words, members, smallest place, the word before them
            carry = [1, places[0], left[0]]
            for i in range(len(slots) + 1):
                length = lengths[i] if i < len(slots) else 0
                while open_ and open_[-1][0] > length:
                    words, members, first, word = open_.pop()
                    members, first = members + carry[0], min(first, carry[1])
                    word = word if word == carry[2] else mixed
                    if word == mixed:
                        yield first, words, members
                    carry = [members, first, word]
                if i == len(slots):
                    break
                if open_ and open_[-1][0] == length:
                    top = open_[-1]
                    top[1], top[2], top[3] = top[1] + carry[0], min(top[2], carry[1]), top[3] if top[3] == carry[2] else mixed
                else:
                    open_.append([length, *carry])
                carry = [1, places[i + 1], left[i + 1]]


def _united(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of ``least`` words or more."""
    at = np.flatnonzero(longest >= least)
    change = np.zeros(len(longest) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + longest[at], -1)
    return np.cumsum(change[:-1]) > 0


def _per_text(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; ``before`` are the counts of values before each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[before[1:]] - sums[before[:-1]]


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    starts, ends, before = spans(data, offsets, _NOT_NEWLINE)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SOLID_BYTES[data], out=solid[1:])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    worded = solid[ends] > solid[starts]
    starts, ends, text = starts[worded], ends[worded], text[worded]
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    _, codes = distinct_spans(data, starts, ends)
    different = np.unique(text * len(codes) + codes) // len(codes)
    return np.bincount(text, minlength=len(offsets) - 1) - np.bincount(different, minlength=len(offsets) - 1)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text, class of every word)."""
    starts, ends, before = spans(data, offsets, SOLID_BYTES)
    codes = distinct_spans(data, starts, ends)[1] if len(starts) else np.empty(0, np.int64)
    return starts, ends, before, codes


def _measured(data: np.ndarray, offsets: np.ndarray) -> list[dict]:
    starts, ends, before, codes = _words(data, offsets)
    n = np.diff(before)
    text = np.repeat(np.arange(len(n)), n)
    longest = Suffixes(codes, text).longest()
    covered = _united(longest, REPEAT_WORDS)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_FIRST_BYTES[data], out=chars[1:])
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, text, longest)
    columns = [
        n,
        _per_text(chars[ends] - chars[starts], before),
        _per_text(_SYMBOLS[data], offsets),
        _repeated_lines(data, offsets),
        _per_text(_united(longest, WINDOW), before),
        _per_text(covered, before),
        most,
    ]
    begins, sizes, spans_before = spans(covered.astype(np.uint8), before, np.array([False, True]))
    sizes = sizes - begins
    own = begins - before[np.repeat(np.arange(len(n)), np.diff(spans_before))]
    names = [f.split()[0] for f in MEASURES.split(", ")]
    flat_spans = [{"begin": b, "size": s} for b, s in zip(own.tolist(), sizes.tolist(), strict=True)]
    lists = [flat_spans[a:b] for a, b in zip(spans_before[:-1].tolist(), spans_before[1:].tolist(), strict=True)]
    return [dict(zip(names, row, strict=True)) for row in zip(*[c.tolist() for c in columns], lists, strict=True)]


def measured(docs: DataFrame, text: str = "text", name: str = "repetition") -> DataFrame:
    """Add the measures of every text as one struct column.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in windows of WINDOW words that occur twice or more),
    covered_words and spans (the united places of repeats of REPEAT_WORDS words or more), longest_repeat in words.
    """

    @F.arrow_udf(f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = None
        for texts in batches:
            data, offsets = flat(texts)
            rows = []
            for a, b in pieces(offsets):
                rows += _measured(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            kind = kind or _arrow_type()
            yield pa.array(rows, kind)
            release()

    return docs.withColumn(name, run(F.col(text)))


def _arrow_type() -> pa.DataType:
    span = pa.struct([("begin", pa.int32()), ("size", pa.int32())])
    names = [f.split()[0] for f in MEASURES.split(", ")]
    return pa.struct([(c, pa.list_(span) if c == "spans" else pa.int64()) for c in names])


def maximal_repeats(docs: DataFrame, text: str = "text", name: str = "repeats", least: int = REPEAT_WORDS) -> DataFrame:
    """Add every maximal repeat of a text: its first place and size in words, and how often it occurs."""

    @F.arrow_udf(REPEATS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("size", pa.int32()), ("times", pa.int32())]))
        for texts in batches:
            data, offsets = flat(texts)
            out = []
            for a, b in pieces(offsets):
                _, _, before, codes = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                of = np.repeat(np.arange(b - a), np.diff(before))
                rows: list[list[dict]] = [[] for _ in range(b - a)]
                for first, size, times in Suffixes(codes, of).maximal(codes, least):
                    rows[of[first]].append({"begin": int(first - before[of[first]]), "size": size, "times": times})
                out += [sorted(r, key=lambda x: (x["begin"], x["size"])) for r in rows]
            yield pa.array(out, kind)
            release()

    return docs.withColumn(name, run(F.col(text)))


def fails_base(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])


def repeats_too_much(m: Column) -> Column:
    return (100 * m["covered_words"] > COVERED_PERCENT * m["n_words"]) | (m["longest_repeat"] > LONGEST_WORDS)
