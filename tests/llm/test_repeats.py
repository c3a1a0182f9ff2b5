import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import EDGE, as_docs, prose, unique_words

from skuloom.llm import repeats

SOLID = re.compile("[^\x20\x09-\x0d]+")


def covered(words, size):
    """Words in windows of ``size`` words that stand in the text twice or more."""
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    times = Counter(windows)
    inside = set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(i, i + size))
    return inside


def longest(words):
    size = 0
    while covered(words, size + 1):
        size += 1
    return size


def runs(places):
    out = []
    for p in sorted(places):
        if out and p == out[-1][0] + out[-1][1]:
            out[-1][1] += 1
        else:
            out.append([p, 1])
    return [tuple(r) for r in out]


def expected(text):
    text = text or ""
    words = SOLID.findall(text)
    lines = [x for x in text.split("\n") if SOLID.search(x)]
    long = covered(words, repeats.REPEAT_WORDS)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered(words, 3)), len(long), longest(words), runs(long),
    )


def got(spark, texts):
    rows = repeats.measured(as_docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    return [tuple(r.repetition)[:-1] + ([(s.begin, s.size) for s in r.repetition.spans],) for r in rows]


def random_text(rng):
    words = rng.choice([["a"], ["a", "b"], ["a", "b", "c", "é", "#", "日本"]])
    text = "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "\r", "\x0b ", "\n\n"]) for _ in range(rng.randint(0, 60)))
    return text + rng.choice(["", text, "tail " + text])


def test_random_texts(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(300)]
    line = " ".join(unique_words(1, 9))
    texts += ["\n".join([line, prose(1, 30), line, line]), prose(3, 150), "x " * 150, None, "", " \n \n", "a\n b\na\n b"]
    assert got(spark, texts) == [expected(t) for t in texts]


def test_edge_rows(spark, edge, nothing):
    assert repeats.measured(nothing).collect() == [] and repeats.maximal_repeats(nothing).collect() == []
    rows = repeats.measured(edge)
    assert rows.columns == [*edge.columns, "repetition"]
    want = sorted((i or 0, *expected(t)[:5]) for i, t in EDGE if i != 8)
    assert sorted((r.doc_id or 0, *tuple(r.repetition)[:5]) for r in rows.collect() if r.doc_id != 8) == want


def test_verdict(spark):
    line = " ".join(unique_words(2, 40))
    long = " ".join(unique_words(3, 201))
    texts = [
        " ".join(unique_words(4, 60)),  # nothing repeats
        " ".join(unique_words(4, 49)),  # too short
        line + "\n" + line,  # all in windows that occur twice
        line + " " + " ".join(unique_words(5, 82)) + " " + line,  # 80 of 162 words in repeats
        long + " " + " ".join(unique_words(6, 1400)) + " " + long,  # a repeat of 201 words
        line + " " + " ".join(unique_words(7, 400)) + " " + line,
    ]
    m = repeats.F.col("repetition")
    rows = repeats.measured(as_docs(spark, list(enumerate(texts)))).orderBy("doc_id").select(repeats.fails_base(m), repeats.repeats_too_much(m))
    assert [tuple(r) for r in rows.collect()] == [
        (False, False), (True, False), (True, True), (False, True), (False, True), (False, False),
    ]


def brute_maximal(words, least):
    n, found = len(words), set()
    for size in range(least, n):
        places: dict[tuple, list[int]] = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        for at in places.values():
            if len(at) < 2:
                continue
            left = {words[i - 1] if i else None for i in at}
            right = {words[i + size] if i + size < n else (None, i) for i in at}
            if len(left) > 1 and len(right) > 1:
                found.add((at[0], size, len(at)))
    return sorted(found)


@pytest.mark.parametrize("least", [1, 2, 8])
def test_maximal_repeats(spark, least):
    rng = random.Random(least)
    texts = [" ".join(rng.choice("ab" if i % 2 else "abcd") for _ in range(rng.randint(0, 40))) for i in range(120)]
    texts += ["a " * 50, prose(1, 300), None, ""]
    rows = repeats.maximal_repeats(as_docs(spark, list(enumerate(texts))), least=least).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        assert [(r.begin, r.size, r.times) for r in row.repeats] == brute_maximal((text or "").split(), least)


def test_common_prefixes_of_long_repeats():
    words = np.array([1, 2, 3, 4] * 500 + [9] + [1, 2, 3, 4] * 500)
    suffixes = repeats.Suffixes(words, np.zeros(len(words), np.int64))
    assert suffixes.longest()[0] == 2000 and max(suffixes.longest()) == 2000
