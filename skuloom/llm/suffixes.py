"""Suffix arrays of bounded depth over symbol arrays, and binary search for many needles at once."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, lo: int, hi: int, depth: int) -> np.ndarray:
    """Positions lo..hi-1 ordered by the ``depth`` symbols from there on (``symbols`` reaches ``depth`` beyond ``hi``).

    As many symbols as fit are packed into one integer and sorted; only what is still tied is sorted again by the next ones.
    """
    part = symbols[lo : hi + depth]
    _, rank = np.unique(part, return_inverse=True)
    bits = max(1, int(rank.max()).bit_length()) if len(rank) else 1
    per = max(1, 63 // bits)
    rank = np.concatenate([rank.astype(np.int64), np.zeros(per, np.int64)])
    key = np.zeros(len(part), np.int64)
    for k in range(per):
        key = (key << bits) | rank[k : k + len(part)]
    key = np.concatenate([key, np.zeros(depth + per, np.int64)])
    n = hi - lo
    order = np.argsort(key[:n])
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    done = per
    while done < depth:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, own = np.cumsum(fresh)[at], order[at]
        later = key[own + done]
        by = np.lexsort((later, group))
        order[at] = own[by]
        group, later = group[by], later[by]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (later[1:] != later[:-1])
        fresh[at] = new
        done += per
    return order + lo


def _bound(array: np.ndarray, symbols: np.ndarray, needles: np.ndarray, place: np.ndarray, need: np.ndarray, after: bool, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) >> 1
        doc, at, size = array[mid], place[open_], need[open_]
        right = np.full(len(open_), after)  # what an equal needle means
        same = np.arange(len(open_))
        k = 0
        while len(same):
            a, b = symbols[doc[same] + k], needles[at[same] + k]
            right[same[a < b]] = True
            right[same[a > b]] = False
            k += 1
            same = same[(a == b) & (size[same] > k)]
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


def _begun(array: np.ndarray, symbols: np.ndarray, needles: np.ndarray, place: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffixes that begin with the first two symbols of each needle, from one sorted array of packed pairs."""
    if symbols.dtype != np.uint32 or not len(place) or need.min() < 1 or need.max() < 2:
        return np.zeros(len(place), np.int64), np.full(len(place), len(array), np.int64)
    pairs = symbols[array].astype(np.uint64) << np.uint64(32) | symbols[array + 1]
    one, two = needles[place].astype(np.uint64) << np.uint64(32), need > 1
    second = needles[place + two].astype(np.uint64)
    low = np.searchsorted(pairs, one | np.where(two, second, np.uint64(0)))
    return low, np.searchsorted(pairs, one | np.where(two, second, np.uint64(0xFFFFFFFF)), "right")


def search(array: np.ndarray, symbols: np.ndarray, needles: np.ndarray, place: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range [low, high) of the suffix array in which each needle, ``need`` symbols from ``place`` on, occurs."""
    begin, end = _begun(array, symbols, needles, place, need)
    low = _bound(array, symbols, needles, place, need, False, begin, end)
    high = low.copy()
    # Only needles that begin the suffix at their lower bound occur at all, and need the other one.
    some = np.flatnonzero(low < len(array))
    k = 0
    going = some[need[some] > 0]
    found = np.ones(len(low), bool)
    found[low >= len(array)] = False
    while len(going):
        same = symbols[array[low[going]] + k] == needles[place[going] + k]
        found[going[~same]] = False
        k += 1
        going = going[same & (need[going] > k)]
    at = np.flatnonzero(found)
    high[at] = _bound(array, symbols, needles, place[at], need[at], True, low[at], end[at])
    return low, high
