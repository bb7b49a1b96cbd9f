"""From raw documents to packed training sequences, in five stages that each work on all their predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardwatch.llm import exact, mixing, packing, quality, simhash
from wardwatch.llm.common import stored, table

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is judged by its host and path alone; null and repeated ids are rows like any other, and rows that repeat an
    id share a verdict only if they share all that decides it.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the one with the most code points, then the smallest id (null last).

    Null and empty texts are equal.
    """
    return exact.deduplicated(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, one with the smallest id (null last). Texts without words are one group with those whose bits agree."""
    return simhash.one_per_group(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources below their target occur more than once, others are sampled; one a source may be cut.

    Null texts have no words and are not taken; a null source is a source of its own.
    """
    return mixing.mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a training sequence. A null text is the end token alone; ids may be null or repeat."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

# Neither the fitted classifier nor fingerprints, tokens and packing can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
