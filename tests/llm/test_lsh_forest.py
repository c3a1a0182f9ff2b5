import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skuloom.llm import lsh_forest as L
from skuloom.llm.components import components
from llm_cases import EDGE, as_docs, unique_words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent=80):
    sets, ids = [], [i for i, _ in rows]
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if None in (ids[a], ids[b]) or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(ids[a]), find(ids[b])
                par[max(x, y)] = min(x, y)
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets, strict=True)], key=str)


def planted():
    rng, rows = random.Random(8), []
    for k in range(30):
        base = unique_words(k, 120)
        rows.append((1000 + 10 * k, " ".join(base)))
        for j in range(1, 5):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 6])):
                w[rng.randrange(len(w))] = "changed"
            rows.append((1000 + 10 * k + j, " ".join(w).upper() if j == 2 else "  ".join(w)))
    hot = unique_words(99, 80)
    for j in range(60):
        w = list(hot)
        w[j] = f"n{j}"
        rows.append((j + 20, " ".join(w)))
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_against_brute_force(spark, words):
    rows = planted() + EDGE
    got = sorted([tuple(r) for r in L.near_duplicates(as_docs(spark, rows), words=words).collect()], key=str)
    assert got == brute(rows, words)


def test_deduplicate(spark, edge, nothing):
    kept = L.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 2, 3, 4, 6, 8, 9, None, None]
    assert L.deduplicate(nothing).collect() == []


def test_neighbours_over_batches():
    """Whatever the batches, each row of a region is passed on with heads that precede it in its region."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = 60
    own = {"tree": np.zeros(n, int), "key": np.sort(rng.integers(0, 6, n)), "deep": rng.integers(0, 3, n) << 32 | rng.integers(0, 2, n)}
    order = np.lexsort((own["deep"], own["key"]))
    own = {c: v[order] for c, v in own.items()} | {"id": np.arange(n), "s1": np.zeros(n, int), "s2": np.zeros(n, int)}
    whole = pa.RecordBatch.from_arrays([pa.array(own[c].astype(np.int64)) for c in own], list(own))
    want = None
    for size in (60, 1, 2, 7):
        got = {}
        for b in L._neighbours(whole.slice(k, size) for k in range(0, n, size)):
            for r in b.to_pylist():
                got[r["id"]] = (r["near"], r["head"])
        heads = {i: h for i, h in got.items() if h != (None, None)}
        want = want or heads
        assert heads == want
    for i, (near, head) in want.items():
        assert own["key"][near] == own["key"][i] and near < i and (head is None or own["key"][head] == own["key"][i])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    par = {i: i for i in range(26)}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")
    got = dict(tuple(r) for r in components(df).collect())
    assert got == {i: find(i) for a, b in pairs if a != b for i in (a, b)}


def test_path_of_many_nodes(spark):
    df = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components(df).collect()} == {0}


def test_rows_of_one_id_with_different_texts_are_documents_of_their_own(spark):
    p, q = " ".join(unique_words(1, 60)), " ".join(unique_words(2, 60))
    docs = as_docs(spark, [(1, p), (2, p), (2, q), (7, p), (7, q + " more"), (9, "alone"), (9, "alone"), (None, p), (None, p), (3, None), (3, "")])
    kept = L.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    # Of the two near copies of q one stays; which of them is decided by hash.
    assert [g for g in got if not g[1].startswith(q)] == [(0, p), (0, p), (1, p), (3, ""), (3, ""), (9, "alone")]
    assert len([g for g in got if g[1].startswith(q)]) == 1


def test_kept_documents_are_not_shuffled(spark):
    """Only rows that the bit map cannot tell from removed ones are joined with them, also where that is no broadcast."""
    rows = planted()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.deduplicate(as_docs(spark, [*rows, (None, "alone")]).repartition(2).selectExpr("*", "doc_id as `__map`", "doc_id as `__gone`"))
        plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = {i for i, _, c in brute(rows, 5) if i == c}
    assert {r.doc_id for r in got} == kept | {None} and len(got) == len(kept) + 1 and out.columns[-2:] == ["__map", "__gone"]
    assert "Union" in plan and "LeftAnti" in plan and "hashpartitioning(__own" not in plan
