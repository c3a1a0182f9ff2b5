"""The named queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.functions.ranks import join_groups
from skuloom.llm import attention_mil, collinear_chains, decontaminate, edit_counts, filter_folds, lsh_forest, phrases, repeats
from skuloom.llm import rp_forest, sentence_pieces, slots, tag_paths, token_store
from skuloom.session import fresh_path, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("contamination")
    return decontaminate.match_benchmark(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["item_ids"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found["item_ids"], ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(found).alias("contaminated"),
    )


ORACLES["op1_suffix_array_decontamination"] = r"""
WITH cut AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (
  SELECT item_id, size, unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS words
  FROM (SELECT *, least(len(w), 13) AS size FROM cut WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM items),
places AS (
  SELECT doc_id, size, unnest(generate_series(1, len(w) - size + 1)) AS i,
    unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS words
  FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, places.size, i, item_id FROM places JOIN items ON places.size = items.size AND places.words = items.words),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS place FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token_store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return token_store.read_store(spark, path, with_ids=False).withColumnRenamed("key", "doc_id")


SHARDS = 16


@query
def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.shard(table(spark, sf_dir, "documents"), SHARDS, fresh_path(spark, "slot_map"))
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query
def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = attention_mil.train(docs, table(spark, sf_dir, "labels"))
    score = F.col("score")
    return attention_mil.scored(docs, model).select(
        "doc_id",
        attention_mil.is_held_out("doc_id").alias("held_out"),
        "score",
        F.when(score >= attention_mil.PREDICTED_FROM, 1).otherwise(0).alias("predicted"),
    )


@query
def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp_forest.near_vectors(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLES["op5_projection_forest"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached(vec_id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT vec_id, b FROM reached JOIN links ON node = a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(node) AS component_id, min(node) = vec_id AS kept
FROM reached LEFT JOIN counted USING (vec_id) GROUP BY vec_id
"""


@query
def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), words=2)
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLES["op6_lsh_forest"] = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, b FROM reached JOIN both_ways ON node = a)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(node) AS component_id, min(node) = doc_id AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


@query
def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentence_pieces.encode(docs, PIECE_BPE, checked="round_trip")
    return rows.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "round_trip")


@query
def op8_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its personal data is replaced by marks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    key = ["doc_id", "text_crc32"]  # rows that agree in both are one document
    trees = edit_counts.counted(docs, BYTE_BPE).select(*key, "tree")
    trees = materialize(trees, fresh_path(spark, "trees"))
    changed = edit_counts.redactions(docs).where(F.size("edits") > 0)
    found = edit_counts.applied(join_groups(changed, trees.dropDuplicates(key), key), BYTE_BPE).select(
        *key,
        F.size("edits").cast("bigint").alias("n_edits"),
        edit_counts.total("tree").alias("n_after"),
        "reencoded_bytes",
        F.crc32(F.col("text").cast("binary")).alias("crc_after"),
    )
    return join_groups(trees, found.dropDuplicates(key), key, "left").select(
        "doc_id",
        edit_counts.total("tree").alias("n_tokens"),
        F.coalesce("n_edits", F.lit(0).cast("bigint")).alias("n_edits"),
        F.coalesce("n_after", edit_counts.total("tree")).alias("n_tokens_after"),
        F.coalesce("reencoded_bytes", F.lit(0).cast("bigint")).alias("reencoded_bytes"),
        F.coalesce("crc_after", "text_crc32").alias("text_crc32"),
    )


@query
def op9_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tag_paths.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op10_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collinear_chains.repeated_passages(table(spark, sf_dir, "documents"))
    names = {"id": "doc_id", "other": "other_id", "begin": "begin_word", "size": "n_words"}
    names |= {"other_begin": "other_begin_word", "other_size": "other_n_words"}
    return found.withColumnsRenamed(names).withColumn("similarity", F.round("similarity", 6))


@query
def op11_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


ORACLES["op11_misra_gries_phrases"] = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
runs AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size)
  GROUP BY lang, size, phrase HAVING count(*) >= 100),
inner_runs AS (
  SELECT DISTINCT lang, f, array_to_string(words[a:b], ' ') AS phrase FROM (
    SELECT lang, f, size, string_split(phrase, ' ') AS words, unnest(generate_series(1, size - 1)) AS a FROM runs WHERE size > 2),
    (SELECT unnest([2, 3, 4, 5]) AS b) WHERE b <= size AND b > a AND b - a + 1 < size),
kept AS (
  SELECT * FROM runs WHERE size > 1 AND NOT EXISTS (
    SELECT 1 FROM inner_runs i WHERE i.lang = runs.lang AND i.phrase = runs.phrase AND 100 * i.f >= 100 * runs.f)),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS tail
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score, k
  FROM cuts JOIN runs x ON x.lang = cuts.lang AND x.phrase = head JOIN runs y ON y.lang = cuts.lang AND y.phrase = tail
    JOIN totals ON totals.lang = cuts.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""


@query
def op12_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("repetition")
    rows = repeats.measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        repeats.fails_base(m).alias("base_failed"),
        (~repeats.fails_base(m) & ~repeats.repeats_too_much(m)).alias("kept"),
    )


ORACLES["op12_suffix_array_repetition"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, size, unnest(generate_series(1, len(w) - size + 1)) AS i,
    unnest(list_transform(generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS words
  FROM docs, (SELECT unnest([3, 8]) AS size) WHERE len(w) >= size),
twice AS (SELECT doc_id, size, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, size, words) > 1),
covered AS (
  SELECT doc_id, size, count(DISTINCT place) AS n FROM (SELECT doc_id, size, unnest(generate_series(i, i + size - 1)) AS place FROM twice)
  GROUP BY doc_id, size),
three AS (SELECT doc_id, n AS n3 FROM covered WHERE size = 3),
eight AS (SELECT doc_id, n AS n8 FROM covered WHERE size = 8),
long AS (
  SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 200), lambda i: array_to_string(w[i:i + 200], ' '))) AS words
  FROM docs JOIN eight USING (doc_id) WHERE n8 > 200),
longest AS (SELECT DISTINCT doc_id, true AS over FROM long GROUP BY doc_id, words HAVING count(*) > 1),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n3, 0) AS BIGINT) AS n_repeat_words, coalesce(n8, 0) AS n8, coalesce(over, false) AS over
  FROM docs LEFT JOIN three USING (doc_id) LEFT JOIN eight USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * n8 > 30 * n_words OR over) AS kept
FROM measured
"""


@query
def op13_filter_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_folds.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_folds"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM (
    SELECT part, good, toxic, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
    FROM docs LEFT JOIN marks USING (doc_id))
  GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders(o, bits, used) AS (
  SELECT '', CAST([] AS INTEGER[]), 0 UNION ALL SELECT o || f, list_append(bits, bit), used + bit FROM orders, letters WHERE (used & bit) = 0),
steps AS (
  SELECT o AS filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier, substr(o, step, 1) AS filter
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5),
counted AS (
  SELECT part, filter_order, step, filter,
    CAST(sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, filter)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counted
"""
