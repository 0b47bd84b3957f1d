"""A training corpus from raw documents: language, near duplicates, benchmark passages, personal data, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the documents of the next one. All stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import decontaminate, language, pieces, pii, simhash
from panelspark.llm.common import documents, stored, vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose likeliest language stays below a probability of 0.3."""
    return language.with_known_language(docs, language.train_language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each SimHash class (4-word shingles, 4 differing bits, as the operator's contract says)."""
    return simhash.without_near_duplicates(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in the place of each span of personal data; ``n_chars`` follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and the digest of the text they decode to."""
    encoded = pieces.encode(docs, pieces.load_model(vocabulary("piece_bpe_32k.model")))
    return encoded.select("doc_id", "ids", "n_tokens", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("benchmark", no_benchmark),
    ("personal_data", no_personal_data),
    ("token_ids", token_ids),
]
#: Models, a transducer and spaced seeds have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
