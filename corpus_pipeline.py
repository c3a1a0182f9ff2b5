"""Documents to token ids: quality, near duplicates, repeated passages, benchmark passages, encoding.

Each stage takes the documents that its predecessor kept, all but the last return the columns of documents, and what
a stage returns is stored as Parquet before the next one reads it. Stages keep rows without id; see each operator for its
defined cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuloom.llm import attention_mil, collinear_chains, decontaminate, lsh_forest, sentence_pieces
from skuloom.session import fresh_path, materialize

PIECES = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those at hand, does not reject."""
    return attention_mil.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of similarity 0.8 or more."""
    return lsh_forest.deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents of nothing else go."""
    out = collinear_chains.cut_passages(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies inside benchmark passages."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    rows = sentence_pieces.encode(docs.select("doc_id", "text"), PIECES, checked="round_trip")
    return rows.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", tokens),
]

#: Trained weights, hashes and merges are beyond SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), fresh_path(spark, name.replace(" ", "_")))
    return docs
