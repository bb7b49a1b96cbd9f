"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. The vectors are rotated to their principal axes, which are
dealt to a few low-dimensional blocks, and the squared distance is shared out among the blocks in proportion to their
variance. A pair within the whole distance is within the share of at least one block, so a range join in each block
finds every link: vectors fall into cells as wide as the block's radius along its strongest axes and meet those of the
same and the neighbouring cells. Where a block's cells would not leave out most pairs, which the counts of the cells tell beforehand,
they are not used: such blocks go through all pairs together, once. What a block finds is verified in double precision on the
vectors as given.

A link found by several blocks counts in the first one only. Links are counted, and reduced to a tree, where they are
found; pairs are never sent, so a large group of near copies costs no more rows than its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwatch.llm.common import stored, table
from wardwatch.llm.components import components
from wardwatch.llm.simhash import forest

COSINE = 0.9
DIMENSIONS = 16  # of a block
AXES = 3  # of a block that have cells, at most
CELLS = 4_000  # that a block may have, or it has cells along fewer axes
WORTH = 0.35  # part of all pairs that a block may compare through its cells; if it is more, they are not used
OPEN = -1  # stands for the blocks without cells
TILE, LEAST_TILE = 8192, 1024  # vectors of a part, at most and at least; a cell with more is split, and each pair of parts is compared
ROWS = 1024  # rows of a distance matrix
PAIRS = 1 << 16  # pairs verified at once
SLACK = 1e-4  # single precision may place a pair this far from a block's squared radius
RELATIVE = 1e-9
WIDER = 1 + 1e-6  # cells than the radius, so that rounding moves no pair past the next cell


class Blocks(NamedTuple):
    rotation: np.ndarray  # a row for each axis, block by block
    bounds: list[int]  # of the blocks' axes
    budgets: list[float]  # squared distances that sum up to the whole one

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.bounds, self.bounds[1:]))

    def width(self, block: int) -> float:
        """Of a block's cells."""
        return float(np.sqrt(self.budgets[block]) * WIDER)

    def axes(self, block: int) -> int:
        """Along how many of its axes, strongest first, a block has cells."""
        a, b = self.spans()[block]
        per_axis = 2 / self.width(block) + 2
        return max(1, min(AXES, b - a, int(np.log(CELLS) / np.log(per_axis))))


def usable(vectors: pd.Series) -> pd.Series:
    """Double arrays of the vectors that have a direction; null for null, empty, zero, null or non-finite components."""

    def one(v):
        if v is None or not len(v):
            return None
        x = np.asarray([np.nan if c is None else c for c in v] if getattr(v, "dtype", None) == object else v, dtype=np.float64)
        return x if np.isfinite(x).all() and x.any() else None

    return vectors.map(one, na_action=None)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=-1, keepdims=True)  # no overflow or underflow
    return scaled / np.linalg.norm(scaled, axis=-1, keepdims=True)


def moments(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of vector the number and the matrix of second moments, added up in tasks first."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            good = usable(batch["embedding"]).dropna()
            for size, rows in good.groupby(good.map(len)):
                x = unit(np.stack(rows.to_list()))
                held = sums.setdefault(size, [0, np.zeros((size, size))])
                held[0], held[1] = held[0] + len(x), held[1] + x.T @ x
        for size, (n, m) in sums.items():
            yield pd.DataFrame({"size": size, "axis": range(size), "n": n, "part": list(m)})

    parts = vectors.select("embedding").mapInPandas(over, "size int, axis int, n long, part array<double>")
    cells = parts.select("size", "axis", "n", F.posexplode("part").alias("other", "value"))
    added = cells.groupBy("size", "axis", "other").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).toPandas()
    out = {}
    for size, rows in added.groupby("size"):
        matrix = np.zeros((size, size))
        matrix[rows["axis"], rows["other"]] = rows["value"]
        out[int(size)] = (int(rows["n"].iloc[0]), (matrix + matrix.T) / 2)
    return out


def blocks_of(matrix: np.ndarray, cosine: float, dimensions: int) -> Blocks:
    """Principal axes dealt to blocks in turn, strongest first, with budgets in proportion to the blocks' variance."""
    size = len(matrix)
    values, axes = np.linalg.eigh(matrix)
    order = np.argsort(-values)
    count = max(1, size // dimensions)
    dealt = [order[i::count] for i in range(count)]
    energy = np.array([max(values[d].sum(), 0.0) for d in dealt])
    share = (energy + energy.sum() * 1e-3 / count + 1e-12) / (energy + energy.sum() * 1e-3 / count + 1e-12).sum()
    bounds = list(accumulate(map(len, dealt), initial=0))
    return Blocks(axes.T[np.concatenate(dealt)], bounds, [float((2 - 2 * cosine) * s) for s in share])


def placed(vectors: DataFrame, blocks: dict[int, Blocks]) -> DataFrame:
    """``row, size, cells`` (in each block, as text) and the vector as it was given, for each vector with a direction."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = usable(batch["embedding"]).dropna()
            for size, rows in good.groupby(good.map(len)):
                chosen = blocks[size]
                turned = unit(np.stack(rows.to_list())) @ chosen.rotation.T
                cells = []
                for k, (a, _) in enumerate(chosen.spans()):
                    places = np.floor(turned[:, a : a + chosen.axes(k)] / chosen.width(k)).astype(np.int64)
                    cells.append([" ".join(map(str, c)) for c in places.tolist()])
                yield pd.DataFrame(
                    {"row": batch.loc[rows.index, "row"].to_numpy(), "size": size, "cells": list(map(list, zip(*cells))), "vector": rows.to_list()}
                )

    return vectors.select("row", "embedding").mapInPandas(over, f"row long, size int, cells array<string>, vector {kind}")


def neighbours(cell: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """The cells next to one that come behind it in their order; a pair of cells is met from one of its sides."""
    for step in product((-1, 0, 1), repeat=len(cell)):
        if step > (0,) * len(cell):
            yield tuple(c + d for c, d in zip(cell, step))


def planned_pairs(counts: dict[tuple[int, ...], int]) -> int:
    """How many pairs a block compares through its cells."""
    inside = sum(n * (n - 1) // 2 for n in counts.values())
    return inside + sum(n * counts.get(other, 0) for cell, n in counts.items() for other in neighbours(cell))


def worth_it(counts: dict[int, dict[int, dict[tuple[int, ...], int]]]) -> dict[int, list[int]]:
    """For each size of vector the blocks whose cells leave out most pairs."""
    chosen = {}
    for size, blocks in counts.items():
        every = sum(next(iter(blocks.values())).values())
        chosen[size] = [b for b, cells in blocks.items() if planned_pairs(cells) <= WORTH * every * (every - 1) / 2]
    return chosen


def tile_size(rows: int, tasks: int) -> int:
    """Parts small enough that their pairs keep all tasks busy, and large enough that a vector is not sent more often than that needs."""
    return int(min(TILE, max(LEAST_TILE, rows / np.ceil(np.sqrt(4 * tasks)))))


def seats_of(cells: DataFrame, counts: dict[int, dict[int, dict[tuple[int, ...], int]]], pruned: dict[int, list[int]], tile: int) -> DataFrame:
    """Each vector once for each tile it takes part in: ``size, block, a, b, i, j, part, side``.

    A tile is a part i of a cell a with a part j of the same cell (j >= i) or of a neighbouring one, b. Parts are numbered by
    a hash of the row, and a cell's number of parts follows from its count, so that tiles have a bounded size. The
    blocks without cells share one cell. The lookup has a row for each cell that occurs, at most ``CELLS`` for each block.
    """
    known, number = [], 0
    for size, blocks in counts.items():
        rows = sum(next(iter(blocks.values())).values())
        open_blocks = len(blocks) > len(pruned[size])
        if open_blocks:
            known.append((size, OPEN, "", number, -(-rows // tile), [], []))
            number += 1
        for block in pruned[size]:
            ids = {cell: number + k for k, cell in enumerate(blocks[block])}
            parts = {cell: -(-n // tile) for cell, n in blocks[block].items()}
            number += len(ids)
            ahead = {cell: [o for o in neighbours(cell) if o in ids] for cell in ids}
            behind: dict[tuple[int, ...], list] = {cell: [] for cell in ids}
            for cell, others in ahead.items():
                for other in others:
                    behind[other].append(cell)
            for cell, number_of in ids.items():
                known.append((
                    size, block, " ".join(map(str, cell)), number_of, parts[cell],
                    [(ids[o], parts[o]) for o in ahead[cell]], [(ids[o], parts[o]) for o in behind[cell]],
                ))
    near = "array<struct<id:int,parts:int>>"
    lookup = cells.sparkSession.createDataFrame(known, f"size int, block int, cell string, id int, own int, ahead {near}, behind {near}")
    named = F.concat(
        F.transform("cells", lambda c, i: F.struct(i.cast("int").alias("block"), c.alias("cell"))), F.array(F.struct(F.lit(OPEN).alias("block"), F.lit("").alias("cell")))
    )
    joined = cells.select("row", "size", "vector", F.inline(named)).join(F.broadcast(lookup), ["size", "block", "cell"])
    part, none = F.col("part"), F.array().cast("array<int>")

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)

    def seat(a: Column, b: Column, i: Column, j: Column, side: int) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    own = F.col("id")
    inside = F.transform(upto(F.col("own")), lambda k: seat(own, own, F.least(k, part), F.greatest(k, part), 0))
    forward = F.flatten(F.transform("ahead", lambda o: F.transform(upto(o["parts"]), lambda k: seat(own, o["id"], part, k, 0))))
    backward = F.flatten(F.transform("behind", lambda o: F.transform(upto(o["parts"]), lambda k: seat(o["id"], own, k, part, 1))))
    numbered = joined.withColumn("part", F.pmod(F.xxhash64("row", F.lit(11)), "own").cast("int"))
    return numbered.select("row", "size", "vector", "block", "part", F.inline(F.concat(inside, forward, backward)))


def compare(rows: pd.DataFrame, blocks: Blocks, members: list[int], other: bool, i: int, j: int, cosine: float):
    """The verified links of one tile that belong to these blocks, as pairs of indices, some at a time."""
    whole = unit(np.stack(rows["vector"].to_list()).astype(np.float64))
    turned = whole @ blocks.rotation.T
    low = [np.ascontiguousarray(turned[:, a:b], dtype=np.float32) for a, b in (blocks.spans()[k] for k in members)]
    squares = [np.einsum("ij,ij->i", x, x) for x in low]
    if other:
        left, right = np.flatnonzero(rows["side"].to_numpy() == 0), np.flatnonzero(rows["side"].to_numpy() == 1)
    elif i != j:
        left, right = np.flatnonzero(rows["part"].to_numpy() == i), np.flatnonzero(rows["part"].to_numpy() == j)
    else:
        left = right = np.arange(len(rows))
    for start in range(0, len(left), ROWS):
        some = left[start : start + ROWS]
        others = right[start:] if right is left else right
        if not len(others):
            continue
        close = None
        for k, x, square in zip(members, low, squares):
            near = (x[some] * -2) @ x[others].T
            near += square[others]
            inside = near <= (blocks.budgets[k] + SLACK - square[some])[:, None]
            close = inside if close is None else np.logical_or(close, inside, out=close)
        x, y = np.nonzero(close)
        x, y = some[x], others[y]
        if right is left:
            keep = x < y
            x, y = x[keep], y[keep]
        for at in range(0, len(x), PAIRS):  # bounds what the verification holds
            p, q = x[at : at + PAIRS], y[at : at + PAIRS]
            owns = owned(turned, p, q, blocks, members)
            p, q = p[owns], q[owns]
            good = np.einsum("ij,ij->i", whole[p], whole[q]) >= cosine
            yield p[good], q[good]


def owned(turned: np.ndarray, p: np.ndarray, q: np.ndarray, blocks: Blocks, members: list[int]) -> np.ndarray:
    """Whether the first block whose share holds the pair is one of these. All tiles of a pair compute the same numbers."""
    first, out = np.ones(len(p), dtype=bool), np.zeros(len(p), dtype=bool)
    for k, ((a, b), budget) in enumerate(zip(blocks.spans(), blocks.budgets)):
        inside = ((turned[p, a:b] - turned[q, a:b]) ** 2).sum(axis=1) <= budget * (1 + RELATIVE) + 1e-12
        if k in members:
            out |= first & inside
        first &= ~inside
    return out


def tile_links(blocks: dict[int, Blocks], pruned: dict[int, list[int]], cosine: float):
    def over(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size, block, a, b, i, j = (int(k) for k in key)
        members = [block] if block != OPEN else [k for k in range(len(blocks[size].budgets)) if k not in pruned[size]]
        rows = rows.sort_values("row", ignore_index=True)
        links = np.zeros(len(rows), dtype=np.int64)

        def steps():
            for p, q in compare(rows, blocks[size], members, a != b, i, j, cosine):
                links[:] += np.bincount(p, minlength=len(rows)) + np.bincount(q, minlength=len(rows))
                yield p, q

        ids = rows["row"].to_numpy()
        root = forest(len(rows), steps())
        return pd.DataFrame({"a": ids, "b": ids[root], "links": links})[links > 0]

    return over


def similar(vectors: DataFrame, cosine: float = COSINE, dimensions: int = DIMENSIONS, tile: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``.

    Rows are compared, copies and rows that repeat an id included. Vectors without a direction, and vectors of other
    lengths, link with nothing. ``component_id`` is the smallest id of the component (null only if it has none), and
    a row is kept if its id is that one.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = stored(vectors.select("vec_id", embedding.alias("embedding"), F.monotonically_increasing_id().alias("row")), "vectors")
    blocks = {size: blocks_of(m, cosine, dimensions) for size, (_, m) in moments(rows).items()}
    cells = stored(placed(rows, blocks), "cells")
    counted = cells.select("size", F.posexplode("cells").alias("block", "cell")).groupBy("size", "block", "cell").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[int, dict[int, dict[tuple[int, ...], int]]] = {}
    for r in counted.collect():  # a row for each cell
        counts.setdefault(r["size"], {}).setdefault(r["block"], {})[tuple(map(int, r["cell"].split()))] = r["n"]
    pruned = worth_it(counts)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work goes by pairs, not by bytes
    every = sum(n for blocks_of_size in counts.values() for n in next(iter(blocks_of_size.values())).values())
    seats = seats_of(cells, counts, pruned, tile or tile_size(every, tasks))
    tiles = ["size", "block", "a", "b", "i", "j"]
    links = seats.repartition(tasks, *tiles).groupBy(*tiles).applyInPandas(tile_links(blocks, pruned, cosine), "a long, b long, links long")
    found = stored(links, "tile-links")
    numbers = stored(found.groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "row"), "link-counts")
    roots = stored(components(found.select("a", "b")).withColumnRenamed("node", "row"), "roots")
    ids = rows.select("row", "vec_id")
    rooted = stored(
        ids.join(numbers, "row", "left").join(roots, "row", "left")
        .select("vec_id", "row", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "row").alias("root")),
        "rooted",
    )
    lowest = stored(rooted.groupBy("root").agg(F.min("vec_id").alias("component_id")), "lowest")
    return rooted.join(lowest, "root").select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op3_embedding_pigeonhole(spark: SparkSession, folder: str) -> DataFrame:
    return similar(table(spark, folder, "embeddings"))


OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN lowest USING (vec_id) LEFT JOIN counted USING (vec_id)
"""
