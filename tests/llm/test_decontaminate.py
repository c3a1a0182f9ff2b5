import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skuloom.llm import decontaminate as D
from skuloom.llm.suffixes import search, suffix_array
from llm_cases import EDGE, as_docs, unique_words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[s : s + n]:
                        hit.update(range(k, k + n))
                        names.add(str(name) if name is not None else "null")
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def found(docs, benchmark, **options):
    c = F.col("contamination")
    rows = D.match_benchmark(docs, benchmark, **options).select("doc_id", c["n_words"], c["n_hit"], c["item_ids"]).collect()
    return sorted([(r[0], r[1], r[2], list(r[3])) for r in rows], key=str)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_against_brute_force(spark):
    a, b = unique_words(1, 60), unique_words(2, 30)
    items = [(1, " ".join(a)), (2, " ".join(a[10:30])), (3, " ".join(b)), (3, " ".join(b)), (4, "Tiny item"), (None, " ".join(b)), (5, None), (6, "...")]
    docs = [
        (1, "x y " + ", ".join(a[5:25]).upper() + " z"),
        (2, " ".join(a[5:17])),
        (3, " ".join(b[:14] + b[:14]) + " tiny ITEM tiny item"),
        (4, " ".join(a) + " " + " ".join(a)),
        (4, " ".join(a) + " " + " ".join(a)),
        (5, " ".join(unique_words(3, 4000) + a[20:40])),
        *EDGE[:10],
    ]
    frame = as_docs(spark, docs)
    assert found(frame, bench(spark, items)) == brute(docs, items)
    assert found(frame, bench(spark, items), block_bytes=100) == brute(docs, items)
    want = sorted([str(i) for i, n, h, _ in brute(docs, items) if not (h and 20 * h >= n)])
    assert sorted(str(r[0]) for r in D.decontaminate(frame, bench(spark, items)).collect()) == want
    assert D.decontaminate(frame, bench(spark, items)).columns == frame.columns


def test_places_of_matches(spark):
    a = unique_words(7, 40)
    frame = as_docs(spark, [(1, " ".join(["q", "r", *a[10:35], "s"]))])
    (m,) = D.match_benchmark(frame, bench(spark, [(9, " ".join(a))])).select("contamination.matches").first()[0]
    assert (m.doc_word, m.n_words, m.item_word, m.item_ids) == (2, 25, 10, ["9"])


def test_nothing(spark, edge, nothing):
    empty = bench(spark, [])
    assert all(n == 0 for _, _, n, _ in found(edge, empty))
    assert found(nothing, bench(spark, [(1, "a b")])) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 20))
def test_suffix_array_order(values, depth):
    text = np.array(values + [0] * depth, np.uint64)
    got = suffix_array(text, 0, len(values), depth)
    keys = [tuple(text[i : i + depth]) for i in got]
    assert sorted(got.tolist()) == list(range(len(values))) and keys == sorted(keys)
    needle = np.array(values[: min(3, depth)], np.uint64)
    low, high = search(got, text, needle, np.array([0]), np.array([len(needle)]))
    assert sorted(got[low[0] : high[0]]) == [i for i in range(len(values)) if (text[i : i + len(needle)] == needle).all()]
