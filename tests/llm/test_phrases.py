import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import EDGE, as_docs, prose, unique_words

from skuloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, threshold, top):
    """rows: (group, text)."""
    f, n = Counter(), Counter()
    for group, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[group or "und"] += len(words)
            f.update((group or "und", *words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    candidates = {k: c for k, c in f.items() if len(k) > 2 and c >= threshold}

    def inside(short, long):
        return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))

    scored: dict[str, list] = {}
    for k, a in candidates.items():
        g, *w = k
        if any(len(q) > len(k) and q[0] == g and c >= a and inside(w, list(q[1:])) for q, c in candidates.items()):
            continue
        cuts = [(1000 * a * n[g] // (f[(g, *w[:i])] * f[(g, *w[i:])]), i, f[(g, *w[:i])], f[(g, *w[i:])]) for i in range(1, len(w))]
        score, _, left, right = min(cuts)
        scored.setdefault(g, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (g, i + 1, p.decode(), -a, left, right, n[g], -score)
        for g, found in scored.items()
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])
    )


def mined(spark, rows, threshold, top=2000):
    docs = spark.createDataFrame([(g, t, 1, "x") for g, t in rows], "lang string, text string, n int, phrase string")
    return sorted(tuple(r) for r in phrases.collocations(docs, threshold=threshold, top=top).collect())


ROWS = [
    *[("en", prose(i, 60)) for i in range(40)],
    *[("en", "New York City, new york CITY! the very\tsame words stand here\nnew york") for _ in range(7)],
    *[(None, "été à la plage; 日本 語 🙂 日本 語") for _ in range(6)],
    ("und", "日本 語"),
    ("de", None),
    ("de", ""),
    ("de", " .,;\n "),
    ("fr", "wort " * 3000),
]


@pytest.mark.parametrize(("threshold", "top"), [(5, 2000), (6, 3), (40, 10)])
def test_against_counting_everything(spark, threshold, top):
    assert mined(spark, ROWS, threshold, top) == expected(ROWS, threshold, top)


def test_many_hash_partitions(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PARTITION_BYTES", 500)
    rows = [("en", prose(i, 50) + " " + " ".join(unique_words(i, 60))) for i in range(150)]
    assert mined(spark, rows, 30) == expected(rows, 30, 2000)


def test_edge_rows(spark, edge, nothing):
    assert phrases.collocations(nothing).collect() == []
    got = sorted(tuple(r) for r in phrases.collocations(edge, threshold=20).collect())
    assert got == expected([("en", t) for _, t in EDGE], 20, 2000)
    assert phrases.collocations(as_docs(spark, [(1, None), (2, "one two")]), threshold=2).collect() == []


def test_two_words_at_most(spark):
    rows = [("en", "a b c") for _ in range(9)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {r.phrase for r in phrases.collocations(docs, longest=2, threshold=5).collect()} == {"a b", "b c"}


@pytest.mark.parametrize("seed", range(20))
def test_summary_keeps_what_is_frequent(seed):
    rng = np.random.default_rng(seed)
    threshold = int(rng.integers(2, 60))
    stream = np.concatenate([rng.integers(0, 5000, 20_000), rng.zipf(1.3, 10_000) % 3000, np.repeat(rng.integers(6000, 6200, 5), threshold)])
    rng.shuffle(stream)
    summary = phrases.MisraGries(len(stream), threshold, pending=64)
    summary.pending = 64  # merge often
    for block in np.array_split(stream, int(rng.integers(1, 400))):
        summary.add(*(x.astype(t) for x, t in zip(np.unique(block, return_counts=True), (np.uint64, np.int64), strict=True)))
    frequent = {k for k, c in Counter(stream.tolist()).items() if c >= threshold}
    assert frequent <= set(summary.survivors().tolist())
    assert len(summary.keys) <= summary.capacity and summary.lost < threshold


@pytest.mark.parametrize("limit", [1, 3, 7, 20, 10_000])
def test_chunks_end_between_pieces(limit):
    rng = random.Random(limit)
    texts = ["".join(rng.choice("ab .,\n") for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["x" * 200]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    ranges = list(phrases._chunks(data, offsets, limit))
    assert [a for a, _ in ranges] == [0, *[b for _, b in ranges[:-1]]] and ranges[-1][1] == len(data)
    assert all(b in offsets or phrases._MARKS[data[b - 1]] for _, b in ranges)
