import random
import re
from itertools import permutations

from llm_cases import prose, unique_words

from skuloom.llm import filter_folds

SCHEMA = "doc_id bigint, text string, source string, mask int, n string, part int, first string"


def mask(rows, i):
    key, text, _ = rows[i]
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    fails = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows),
    }
    return {f for f, bad in fails.items() if bad}


def expected(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    masks = [mask(rows, i) for i in range(len(rows))]
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            standing = set(own)
            for step, f in enumerate(order, 1):
                failing = {i for i in own if f in masks[i]}
                removed = failing & standing
                redundant = len(failing - standing)
                standing -= removed
                lost = [sum(rows[i][0] is not None and rows[i][0] in marks for i in removed) for marks in (good, toxic)]
                alone = sum(masks[i] == {f} for i in own)
                out[part, order, step] = [f, len(standing), len(removed), redundant, alone, *lost]
        for f in "ABCDE":
            total = sum(v[2] for k, v in out.items() if k[0] == part and v[0] == f)
            for k, v in out.items():
                if k[0] == part and v[0] == f:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, 9, "n", 1, "f") for i, t, s in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_folds.audit(docs, marks).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    names = ["filter", *filter_folds.COUNTS, "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got}


def test_against_applying_every_order(spark):
    rng = random.Random(3)
    texts = [None, "", "short", prose(1, 80), " ".join(unique_words(1, 70)), " ".join(unique_words(2, 60)).upper(), "$ " + " ".join(unique_words(3, 55))]
    texts += ["été É " * 30, "A\x0bB\tC", "Ab " * 100, " ".join(unique_words(4, 50)) + " #"]
    ids = [*range(60), 5, 5, 7, None, None, None]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in ids]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 60, 2), 5, 5, None, 999]]
    assert audited(spark, rows, labels) == expected(rows, labels)


def test_one_text_in_all_rows(spark):
    rows = [(i // 2, "same", "s" if i % 3 else "t") for i in range(200)]
    assert audited(spark, rows, [(0, 1, 1)]) == expected(rows, [(0, 1, 1)])


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    rows = [(1, "one", "s")]
    assert audited(spark, rows, []) == expected(rows, [])


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "one", "s")], "doc_id bigint, text string, source string")
    plan = filter_folds.masked(docs, "doc_id", "text", "source")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
