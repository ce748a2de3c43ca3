"""Corpus preparation: toxicity, exact dedup, near-dedup, PII, packing.

Every stage reads all that the one before it kept and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, packing, pii, simhash, toxicity
from tessera.llm.common import documents, materialise

#: Near duplicates: words of a shingle, and the similarity from which documents are of one group.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: Discount of disclosing words: at 1 what a single text shows proves nothing, so that rare words of clean prose stay.
ONE_TEXT = 1.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go; the classifier learns from the labels of sf_dir."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the row with the smallest doc_id stays."""
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return simhash.keep_first_similar(docs, NEAR_WORDS, NEAR_SIMILARITY)


def take_out_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that disclose it are replaced in the texts."""
    return pii.sanitise(docs, discount=ONE_TEXT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", take_out_pii),
    ("packing", pack),
]

#: The classifier and the fingerprints have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
