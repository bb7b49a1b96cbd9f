"""Token counts through a cache keyed by the digests of a text and of the tokenizer's version."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from wardwatch.llm.common import stored, table, text_or_empty
from wardwatch.llm.encoding import encoder, version_digest
from wardwatch.session import scratch_path

LIMIT = 512
FEW = 100_000  # digests of 64 characters that are broadcast
CACHE = StructType().add("tokenizer", "string").add("digest", "string").add("n_tokens", "long")


def content_digest() -> Column:
    """SHA-256 of the text that is encoded. Normalising is no more than null to empty: anything else may change the count."""
    return F.sha2(text_or_empty(), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def fill_cache(docs: DataFrame, tokenizer: str, cache: str) -> None:
    """Encode the distinct texts that the cache does not know and append their counts.

    The cache is asked by digests alone. Up to ``FEW`` misses are broadcast, so that only their texts move, and none if there is no
    miss; if there are more, most texts have to move, and are combined by digest before they are compared with the misses. Files
    appear when the whole job has ended; a lost executor repeats its part. Two runs at once may both append a text; their counts are
    equal, and readers take one. A null text is the empty one.
    """
    version = version_digest(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [len(ids) // 4 for ids in encoder(tokenizer).ids(batch["text"].tolist())]
            yield pd.DataFrame({"tokenizer": version, "digest": batch["digest"], "n_tokens": sizes})

    known = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == version).select("digest").distinct()
    texts = docs.select(content_digest().alias("digest"), text_or_empty().alias("text"))
    missing = stored(texts.select("digest").distinct().join(known, "digest", "left_anti"), "missing-digests")
    number = missing.count()
    if not number:
        return
    if number <= FEW:
        misses = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
    else:
        misses = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
    misses.mapInPandas(count, CACHE).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; only texts that the cache misses are encoded.

    Null and empty texts have no bytes; null and repeated ids are carried along, each row has its own.
    """
    fill_cache(docs, tokenizer, cache)
    counts = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == version_digest(tokenizer))
    counts = stored(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    rows = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), content_digest().alias("digest"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """With a cache of its own, so that all counts are made here."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, folder, "documents"), path, scratch_path(spark, "token-cache"))
