import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from skuloom.llm import sentence_pieces as S
from llm_cases import EDGE, SF

NAME = "piece_bpe_32k.model"
PARTS = ["the", "ing", "▁", " ", "  ", "\n", "a", "aa", "aaaa", "Zé", "123", "!!", "日本", "🙂", "<s>", "</s>", "<0x0A>", "\t", "\x00", "er", "in", "://", "ß", "    "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))


def test_ids_are_those_of_the_library(library):
    import pyarrow as pa

    rng, coder = random.Random(5), S.ChunkEncoder(S.vocabulary(NAME))
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "a" * 3000]
    got = [ids[a:b].tolist() for ids, cut in S._encode_texts(coder, pa.array(texts)) for a, b in zip(cut, cut[1:], strict=False)]
    assert got == [library.encode(t or "") for t in texts]


def test_small_stores(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(S, "INDEX_CHARS", 10)
    monkeypatch.setattr(S, "PIECE_BYTES", 40)
    coder = S.ChunkEncoder(S.vocabulary(NAME))
    texts = ["the water under the bridge", "over and over", None, "x " * 30, "the water"]
    got = [ids[a:b].tolist() for ids, cut in S._encode_texts(coder, pa.array(texts)) for a, b in zip(cut, cut[1:], strict=False)]
    assert got == [library.encode(t or "") for t in texts]


def test_round_trip(spark, edge, nothing, library):
    rows = S.encode(edge, NAME).withColumn("back", S.decoded(spark, F.col("ids"), NAME)).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert r.back == (r.text or "").replace("▁", " ") and r.ids == library.encode(r.text or "")
    for r in S.encode(edge, NAME, checked="same").collect():
        assert r.same == ("▁" not in (r.text or "")) and r.ids == library.encode(r.text or "")
    assert S.encode(nothing, NAME).collect() == [] and S.encode(nothing, NAME, checked="same").collect() == []
    docs = S.encode(spark.read.parquet(f"{SF}/documents.parquet"), NAME)
    for r in docs.select("text", "ids").collect():
        assert r.ids == library.encode(r.text)


def test_a_batch_is_encoded_in_slices(spark, library):
    import pyarrow as pa

    texts = pa.array(["the water", None, "", "x" * 40, "over and over"])
    whole = S.PIECE_BYTES
    try:
        S.PIECE_BYTES = 20
        parts = list(S._slices(iter([texts, texts.slice(0, 0), texts.slice(3)])))
    finally:
        S.PIECE_BYTES = whole
    assert [len(p) for p in parts] == [3, 1, 1, 1, 1] and pa.concat_arrays(parts).to_pylist() == [*texts.to_pylist(), *texts.slice(3).to_pylist()]
    docs = spark.range(900).coalesce(1).select("id", F.repeat(F.concat(F.lit("over the bridge "), F.col("id").cast("string")), 200).alias("text"))
    rows = S.encode(docs, NAME, checked="same").collect()  # 3 MB in one batch
    assert [r["id"] for r in rows] == list(range(900)) and all(r["same"] for r in rows)
    assert all(r["ids"] == library.encode(r["text"]) for r in rows[::97])
    plain = S.encode(docs, NAME).collect()
    assert [r["ids"] for r in plain] == [r["ids"] for r in rows]
