"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has 64 bits. Every bit position gets a nonzero vector of ``radius + 1`` bits; for each nonzero vector v there
is a mask with the positions whose own vector has an odd product with v. Any ``radius`` positions span at most ``radius``
dimensions, so some v is orthogonal to all of them and its mask leaves them out: every pair within the radius agrees
under one of the 2 ** (radius + 1) - 1 masks, with certainty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from wardwatch.llm.common import one_of_each, stored, table, text_or_empty
from wardwatch.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 1024  # a larger bucket is split into parts of about this size, and each pair of parts is compared
PIECE = 65_536  # shingles that are counted at once


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bits set in over half the hashes of a text's word shingles, as a signed number; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends + 1 - sizes
    first, last = (starts[: 1 - width].tolist(), ends[width - 1 :].tolist()) if len(words) > width else ([0], [len(joined)])
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), dtype="<u8", count=len(first))
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(texts: Column) -> Column:
    return pandas_udf(lambda series: series.map(fingerprint).astype("int64"), "long")(texts)


def masks(radius: int) -> list[int]:
    """The covering masks, as signed numbers."""
    vectors = 2 ** (radius + 1) - 1
    own = [i % vectors + 1 for i in range(64)]
    unsigned = [sum(1 << i for i in range(64) if (own[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def spread_pairs(size: Column, value: Column, tile: int) -> Column:
    """Pairs of parts in which a row of a bucket with ``size`` rows takes part; one pair if the bucket is small."""
    parts = F.ceil(size / tile).cast("int")
    mine = F.pmod(F.xxhash64(value, F.lit(7)), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda i: i != mine)
    pairs = F.transform(others, lambda i: F.struct(F.least(i, mine).alias("i"), F.greatest(i, mine).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    return F.when(size > 2 * tile, pairs).otherwise(alone)


def forest(size: int, steps: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The root of each of ``size`` nodes after joining the pairs of each step. Pairs inside one tree cost no loop."""
    root = np.arange(size)
    for a, b in steps:
        apart = root[a] != root[b]
        if not apart.any():
            continue
        parent = dict()

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for x, y in zip(root[a[apart]].tolist(), root[b[apart]].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        moved = {x: find(x) for x in parent}
        table_of = np.arange(size)
        table_of[list(moved)] = list(moved.values())
        root = table_of[root]
    return root


def close_pairs(run: np.ndarray, values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the same run within the radius, by their distance in the sorted order."""
    for gap in range(1, len(run)):
        same = np.flatnonzero(run[:-gap] == run[gap:])
        if not len(same):
            return
        near = same[np.bitwise_count(values[same] ^ values[same + gap]) <= radius]
        if len(near):
            yield near, near + gap


def linked(radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows sorted by bucket: a link from each fingerprint to the first one of its tree in the bucket."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        run = (rows[["t", "key", "i", "j"]].ne(rows[["t", "key", "i", "j"]].shift())).any(axis=1).cumsum().to_numpy()
        values = rows["fp"].to_numpy(np.int64)
        root = forest(len(values), close_pairs(run, values, radius))
        moved = root != np.arange(len(values))
        return pd.DataFrame({"a": values[moved], "b": values[root[moved]]})

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rows.iloc[-1]
            open_run = (rows["t"] == last["t"]) & (rows["key"] == last["key"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])
            done, rest = rows[~open_run], rows[open_run]
            if len(done):
                yield links(done.reset_index(drop=True))
        if rest is not None and len(rest):
            yield links(rest.reset_index(drop=True))

    return over


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links that join all fingerprints (distinct, column ``fp``) within the radius, and no others."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))]))
    placed = prints.select("fp", keys.alias("bucket")).select("fp", "bucket.t", "bucket.key")
    sizes = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size"))
    large = stored(sizes.where(F.col("size") > 2 * tile), "large-buckets")
    dealt = placed.join(large, ["t", "key"], "left").select(
        "t", "key", "fp", F.inline(spread_pairs(F.coalesce("size", F.lit(1)), F.col("fp"), tile))
    )
    tiles = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return tiles.mapInPandas(linked(radius), "a long, b long")


def grouped(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Per document ``doc_id, fp``, and per fingerprint ``fp, component_id, root, best``.

    ``component_id`` is the smallest ``doc_id`` of the component (null only if it has none), ``best`` whether it occurs
    with this fingerprint first (smallest fingerprint among those), ``copies`` how many rows share both.
    """
    rows = stored(docs.select("doc_id", fingerprints(text_or_empty()).alias("fp")), "fingerprints")
    counted = rows.groupBy("fp", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    prints = stored(
        counted.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copies")).alias("low")).select(
            "fp", F.col("low.doc_id").alias("low_id"), F.col("low.copies").alias("copies")
        ),
        "distinct-fingerprints",
    )
    roots = stored(components(fingerprint_links(prints.select("fp"), radius)).withColumnsRenamed({"node": "fp"}), "roots")
    named = stored(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    lowest = stored(
        named.groupBy("root").agg(F.min(F.struct(F.col("low_id").isNull(), "low_id", "fp", "copies")).alias("low")).select(
            "root", F.col("low.low_id").alias("component_id"), F.col("low.fp").alias("best_fp"), F.col("low.copies").alias("best_copies")
        ),
        "lowest",
    )
    return rows, stored(named.select("fp", "root").join(lowest, "root"), "components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, a row for each document.

    A null text counts as empty. Rows are compared, not ids: rows that repeat a ``doc_id`` with other texts have
    their own component. A null ``doc_id`` never is a component's id, unless all of its rows have none.
    """
    rows, prints = grouped(docs, radius)
    return rows.join(prints, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents with the smallest ``doc_id`` of their component, with all their columns; one row for each component."""
    _, prints = grouped(docs, radius)
    winners = prints.where("fp = best_fp").selectExpr("component_id AS __id", "fp AS __fp", "best_copies AS copies")
    named = docs.select(F.struct("*").alias("__doc"), F.col("doc_id").alias("__id"), fingerprints(text_or_empty()).alias("__fp"))
    return one_of_each(named, winners, ["__id", "__fp"]).select("__doc.*")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
