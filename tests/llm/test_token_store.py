import zlib

import numpy as np
import pytest
from llm_cases import SF, EDGE
from tokenizers import Tokenizer

import public_tokenizers
from skuloom.llm import token_store
from skuloom.llm.queries import QUERIES

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def want(rows, library):
    out, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op2_token_store"](spark, SF).collect())
    assert got == want(rows, library)


def test_edge_cases(spark, edge, nothing, library, tmp_path):
    token_store.write_store(edge, f"{tmp_path}/edge", NAME)
    got = token_store.read_store(spark, f"{tmp_path}/edge").collect()
    by_text = {(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE}
    assert {(r.key, tuple(r.ids[:-1])) for r in got} == by_text and len(got) == len(EDGE)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    keys = [r.key for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    token_store.write_store(nothing, f"{tmp_path}/none", NAME)
    assert token_store.read_store(spark, f"{tmp_path}/none").collect() == []


def test_short_access(spark, library, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_store.write_store(docs, f"{tmp_path}/store", NAME)
    some = spark.createDataFrame([(7,), (150,), (150,), (99_999,), (None,)], "doc_id bigint")
    got = {r.key: r.ids for r in token_store.read_documents(spark, f"{tmp_path}/store", some).collect()}
    texts = dict(docs.where("doc_id in (7, 150)").select("doc_id", "text").collect())
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    assert spark.read.parquet(f"{tmp_path}/store/dictionary").first().bytes
