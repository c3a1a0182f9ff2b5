import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuloom.llm import edit_counts as C
from skuloom.llm.bpe import encoder
from skuloom.llm.queries import QUERIES
from llm_cases import EDGE, SF, as_docs, prose

NAME = "byte_bpe_50k.json"
PARTS = ["'s", "'re", " ", "  ", "\n", "a", "Zé", "12", "!!", "'", "hello", " world", "\t\n", "   x", "日本", "<|endoftext|>"]


def tree(text):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    return C.Tree(encoder(NAME), raw, *next(C._leaves(encoder(NAME), data, np.array([0, len(data)]))))


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_edits_give_the_counts_of_the_edited_text(monkeypatch, leaf):
    monkeypatch.setattr(C, "LEAF_TOKENS", leaf)
    rng = random.Random(leaf)
    for _ in range(120):
        text = "".join(rng.choice(PARTS[:-2] if rng.random() < 0.9 else PARTS) for _ in range(rng.randint(0, 90)))
        t = tree(text)
        for _ in range(5):
            p, n, new = rng.randint(0, len(text)), rng.choice([0, 1, 5, 30]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 2)))
            t.edit(len(text[:p].encode()), len(text[p : p + n].encode()), new.encode())
            text = text[:p] + new + text[p + n :]
            assert t.raw.decode() == text
            assert t.total() == len(encoder(NAME).whole(text)) == sum(t.tokens)


def test_only_the_region_is_encoded_again():
    text = prose(3, 20_000)
    t = tree(text)
    t.edit(len(text) // 2, 3, b"changed words")
    assert 0 < t.reencoded < 2_000
    assert t.total() == len(encoder(NAME).whole(t.raw.decode()))


def test_edit_table(spark, edge, nothing):
    edits = spark.createDataFrame(
        [(6, 2, 0, 3, "Now"), (6, 1, 10**6, 5, "!end"), (2, 1, 0, 0, "fresh text"), (1, 1, None, None, "x"), (4, 1, 0, 9, None), (77, 1, 0, 0, "?"), (None, 1, 0, 0, "?")],
        "doc_id bigint, seq int, start int, n int, text string",
    )
    trees = C.counted(edge, NAME, tree="leaves")
    done = C.applied(C.with_edits(trees, edits), NAME, tree="leaves").withColumn("n", C.total("leaves")).collect()
    assert len(done) == len(EDGE)
    for r in done:
        assert r.n == len(encoder(NAME).whole(r.text or ""))
    texts = {r.doc_id: r.text for r in done}
    assert texts[2] == "fresh text" and texts[1] == "x" and texts[4] == "" and texts[6] == "Now" + dict(EDGE)[6][3:] + "!end"
    assert C.applied(C.with_edits(C.counted(nothing, NAME, tree="leaves"), edits), NAME, tree="leaves").collect() == []


def test_query(spark):
    pattern = re.compile("|".join(f"({p})" for p in C.PERSONAL.values()))
    marks = list(C.PERSONAL)
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op8_edit_aware_counts"](spark, SF).collect()}
    assert sum(r.n_edits for r in got.values()) > 0
    for i, t in texts.items():
        after, n = pattern.subn(lambda m: marks[m.lastindex - 1], t)
        assert (got[i].n_tokens, got[i].n_edits, got[i].n_tokens_after) == (len(encoder(NAME).whole(t)), n, len(encoder(NAME).whole(after)))


def test_redactions_of_null(spark):
    rows = C.redactions(as_docs(spark, [(1, None), (2, "mail a@b.org or 10.0.0.1 or +1 (017) 555-7713")])).orderBy("doc_id").collect()
    assert rows[0].edits == [] and [e.text for e in rows[1].edits] == ["<PHONE>", "<IP>", "<EMAIL>"]
