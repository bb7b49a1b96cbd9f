"""Exact deduplication through an extendible-hash index on shared files. DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardwatch.llm.common import BLANKS, stored, table, text_or_empty
from wardwatch.session import scratch_path

BUCKET_KEYS = 65_536  # a bucket with more distinct texts is split
MAX_DEPTH = 16  # bits of the hash that the directory may use: at most 65,536 slots


class Index(NamedTuple):
    rows: DataFrame  # a row for each document: doc (the columns to keep), doc_id, n, h, row
    directory: DataFrame  # slot (the first ``depth`` bits of the hash), bucket, local_depth
    entries: DataFrame  # a row for each distinct text: bucket, h, chain, sha, group_size, keep_id, keep_row
    places: DataFrame  # a row for each document: doc_id, row, bucket, h, chain
    path: str  # the entries' files, one folder for each bucket
    depth: int  # bits of the directory


def bare_text(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), BLANKS, "")


def hash_of(text: Column) -> Column:
    return F.xxhash64(text)


def slot_of(h: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory_of(hashes: DataFrame, bucket_keys: int, max_depth: int) -> tuple[DataFrame, int]:
    """Double the directory until no bucket is overfull, or ``max_depth`` is reached; later keys then stay in the bucket.

    Keys are counted once for each slot of the deepest directory, and added up for each shorter prefix. A slot's bucket is split as
    often as a prefix of it is overfull. The counts have at most 2 ** ``max_depth`` rows, the overfull prefixes fewer than that in
    all, whatever the input; so they are broadcast.
    """
    cells = stored(hashes.groupBy(slot_of(F.col("h"), max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("keys")), "cells")
    levels = cells.select("cell", "keys", F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1))).alias("level")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {max_depth} - level)")
    )
    held = levels.groupBy("level", "prefix").agg(F.sum("keys").alias("held"))
    overfull = stored(held.where(F.col("held") > bucket_keys).select("level", "prefix"), "overfull")
    splits = levels.join(F.broadcast(overfull), ["level", "prefix"]).groupBy("cell").agg(F.count(F.lit(1)).cast("int").alias("local_depth"))
    leaves = stored(
        cells.select("cell").join(splits, "cell", "left").select("cell", F.coalesce("local_depth", F.lit(0)).alias("local_depth")).select(
            "cell", "local_depth", F.expr(f"shiftleft(shiftright(cell, {max_depth} - local_depth), {max_depth} - local_depth)").alias("bucket")
        ),
        "leaves",
    )
    depth = leaves.agg(F.max("local_depth")).first()[0] or 0
    slots = leaves.select(F.shiftright("cell", max_depth - depth).alias("slot"), "bucket", "local_depth").distinct()
    return stored(slots, "directory"), depth


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def build_index(
    docs: DataFrame, hasher=hash_of, digest=digest_of, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH, keep: list[str] | None = None
) -> Index:
    """Index ``docs(doc_id, text, …)`` by their text without white space; a null text is empty.

    Texts are read once, and written without white space next to their hash; where ``rows`` carry the whole documents, these are written instead,
    and white space is taken out again. Grouping by hash and text compares bytes, and
    combines copies before the shuffle. An owner task has a range of keys: different texts that share a hash are numbered as its chain,
    and a document finds its text by slot, bucket, hash and, where a hash has a chain, its bytes. Of equal texts the row
    with the most code points stays, then the smallest ``doc_id`` (null last), then any one of the equal rows. ``keep``: columns
    of ``docs``, ``text`` among them, that ``rows`` carry along; none unless asked for.
    """
    spark = docs.sparkSession
    named = docs.select(F.struct(*(keep or ["doc_id"])).alias("doc"), "doc_id", F.char_length(text_or_empty()).cast("long").alias("n"), bare_text().alias("bare"))
    held = [] if keep else ["bare"]
    rows = stored(named.select("doc", "doc_id", "n", hasher(F.col("bare")).alias("h"), *held, F.monotonically_increasing_id().alias("row")), "bare-texts")
    if keep:
        rows = rows.withColumn("bare", bare_text("doc.text"))
    texts = rows.groupBy("h", "bare").agg(F.count(F.lit(1)).alias("group_size"), F.min("row").alias("first"))
    texts = stored(texts.select("h", digest(F.col("bare")).alias("sha"), "group_size", "first"), "texts")
    directory, depth = directory_of(texts, bucket_keys, max_depth)

    def housed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("slot", slot_of(F.col("h"), depth)).join(F.broadcast(directory.select("slot", "bucket")), "slot").drop("slot")

    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha", "first")) - 1
    chained = stored(housed(texts).repartitionByRange("bucket", "h").withColumn("chain", chain), "chained")
    places = stored(housed(links_of(rows, chained)), "places")
    counted = places.groupBy("h", "chain", "n", "doc_id").agg(F.min("row").alias("row"))
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("row").alias("not_row")))
    winners = stored(counted.groupBy("h", "chain").agg(best.alias("best")), "winners")
    entries = chained.join(winners, ["h", "chain"]).select(
        "bucket", "h", "chain", "sha", "group_size", F.bitwise_not("best.not_id").alias("keep_id"), F.bitwise_not("best.not_row").alias("keep_row")
    )
    path = scratch_path(spark, "hash-index")
    entries.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "chain").write.partitionBy("bucket").parquet(path)
    return Index(rows.drop("bare"), directory, spark.read.schema(entries.schema).parquet(path), places, path, depth)


def links_of(rows: DataFrame, chained: DataFrame) -> DataFrame:
    """``doc_id, n, row, h, chain`` of each document. Only documents whose hash several texts share are compared with these."""
    keys = rows.select("doc_id", "n", "row", "h")
    shared = stored(chained.where("chain = 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        return keys.withColumn("chain", F.lit(0))
    alone = keys.join(shared, "h", "left_anti").withColumn("chain", F.lit(0))
    mixed = rows.join(shared, "h", "left_semi")
    firsts = stored(mixed.groupBy("h", "bare").agg(F.min("row").alias("first")), "shared-texts")
    known = firsts.join(chained.select("h", "first", "chain"), ["h", "first"])
    found = mixed.join(known, ["h", "bare"]).select("doc_id", "n", "row", "h", "chain")
    return alone.select("doc_id", "n", "row", "h", "chain").unionAll(found)


def duplicates(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``; of rows that repeat an id one is kept.

    A null text counts as empty, and is equal to all texts of nothing but white space; a null ``doc_id`` is kept only if no equal row has
    an id.
    """
    index = build_index(docs, **options)
    return index.places.drop("n").join(index.entries, ["bucket", "h", "chain"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns."""
    index = build_index(docs, keep=docs.columns, **options)
    winners = index.entries.select(F.col("keep_row").alias("row"))
    return index.rows.select("doc", "row").join(winners, "row", "left_semi").select("doc.*")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates(table(spark, folder, "documents"))


OP9_SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k
  FROM documents),
placed AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY k) AS group_size,
    first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS keep_id,
    row_number() OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS place
  FROM bare)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(k) AS text_sha256 FROM placed
"""
