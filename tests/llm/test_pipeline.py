import corpus_pipeline as P
import public_tokenizers
import sentencepiece

from llm_cases import as_docs, prose, unique_words


def tables(spark, path, docs, items, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_one_by_one(spark, tmp_path):
    item, shared, copy = unique_words(70, 40), unique_words(71, 90), unique_words(72, 100)
    rows = [(i, prose(i, 60, tuple(unique_words(200 + i, 40)))) for i in range(60)]
    rows += [(100 + i, ("BUY NOW!!! $$$ " * 30)[i:]) for i in range(40)]
    rows += [(200, " ".join(copy)), (201, " ".join([*copy[:-1], "other"]))]
    rows += [(210, " ".join(unique_words(5, 80) + shared)), (211, " ".join(shared + unique_words(6, 80)))]
    rows += [(220, " ".join(unique_words(8, 20) + item)), (221, None), (222, "")]
    sf = tables(spark, tmp_path, as_docs(spark, rows), [(1, " ".join(item))], [(i, int(i < 60), 0) for i in (*range(60), *range(100, 140))])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = P.STAGES[0][1](spark, docs, sf)
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and not ids & set(range(100, 140)) and ids >= {*range(60), 200, 201, 210, 211, 220}
    ids = {r.doc_id for r in P.STAGES[1][1](spark, good, sf).collect()}
    assert 200 in ids and 201 not in ids and {210, 211, 220} <= ids
    cut = {r.doc_id: r for r in P.STAGES[2][1](spark, docs, sf).collect()}
    assert cut[211].text == " ".join(unique_words(6, 80)) and cut[211].n_chars == len(cut[211].text)
    assert cut[210].text == dict(rows)[210] and cut[201].text == "other"
    assert {i for i, _ in rows} - {r.doc_id for r in P.STAGES[3][1](spark, docs, sf).collect()} == {220}
    out = P.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {*range(60), 200, 210, 211} and all(r.round_trip for r in out)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.PIECES))
    texts = dict(rows) | {211: cut[211].text}
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, as_docs(spark, []), [], [])
    assert P.run(spark, sf).collect() == []
