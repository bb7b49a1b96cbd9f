"""Connected components of a graph of any size by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwatch.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(a, b)``: the smallest node reachable. Roots themselves do not appear.

    Each round links every node's larger neighbours, and then its smaller ones, to the smallest node it knows. Minima are
    aggregated before the shuffle and stored before they are joined, so that a node with very many neighbours is
    split over tasks. A round's edges are written to the shared folder; the number of edges never grows.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    seen = mark(links)
    while True:
        links = stored(small_star(stored(large_star(links), "large")), "small")
        now = mark(links)
        if now == seen:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now


def mark(links: DataFrame) -> tuple:
    """A fingerprint of a set of edges, one row."""
    digest = F.xxhash64("hi", "lo")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(digest), F.sum(F.pmod(digest, F.lit(1_000_003)))).first())


def large_star(links: DataFrame) -> DataFrame:
    both = links.selectExpr("hi AS u", "lo AS v").unionAll(links.selectExpr("lo AS u", "hi AS v"))
    least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "minima")
    return both.where("v > u").join(least, "u").selectExpr("v AS hi", "m AS lo").distinct()


def small_star(links: DataFrame) -> DataFrame:
    least = stored(links.groupBy("hi").agg(F.min("lo").alias("m")), "minima")
    joined = links.join(least, "hi")
    pairs = F.array(
        F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    )
    return joined.select(F.inline(pairs)).where("hi <> lo").distinct()
