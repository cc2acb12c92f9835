"""From raw documents to packed sequences: stages that run one after the other, each on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from densefold.llm import jaccard, langid, packing, substrings
from densefold.llm.common import Scratch

#: Shortest repeated passage that is cut, in bytes: some 25 words, so that passages of 50 words and more go and stock phrases stay.
PASSAGE = 150


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null texts, texts without a letter) go, and so do those that the model takes with certainty for another language than they declare."""
    return langid.keep_identified(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more, the one of the least doc_id stays."""
    return jaccard.keep_first(spark, docs, words=5, num=8, den=10)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents of which nothing is left go."""
    return substrings.cut_texts(spark, docs, length=PASSAGE)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, cap=1024)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("best-fit packing", packed_sequences)]
#: Tokens, a trained model and components can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
