"""Training corpus from ``documents``: five stages, each over all rows that its predecessor kept.

Stages read and return DataFrames; between them the rows are written as Parquet in the shared folder and read again, so an
executor that is lost costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm import bpe, decontaminate, ngram_join, quality, substring_dedup
from mnemora.llm.common import prepared, saved, table


#: Near duplicates: words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on the labelled rows of ``docs``."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id."""
    prepared(spark)
    return ngram_join.one_of_each(docs, SHINGLE, PERCENT)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in documents with smaller ids."""
    prepared(spark)
    return substring_dedup.shortened(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with an item of ``benchmark``."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    prepared(spark)
    return bpe.digests(docs, bpe.vocabulary_path())


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", uncontaminated),
    ("BPE encoding and decoding", token_digests),
]

#: The trained classifier and the tokenizer have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the digests of the tokens."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
