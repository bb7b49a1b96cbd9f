"""Best-fit packing of token sequences by linear grouping.

Token counts are integers up to the length of a sequence, so the pieces' lengths fit in a histogram with one row for
each length, however many documents there are. The packing is planned on it: large lengths are dealt into groups of
equal cardinality and rounded up to the largest of their group; the few sizes left are packed by column generation;
the actual lengths go into the places of their group; small pieces are then put where they fit best. The plan is a
list of ranges "pieces of this length, from this rank to that one, go to sequences from this number on, at this
place"; pieces are ranked within their length without a shuffle and take their places from it.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wardwatch.llm.batches import text_slices
from wardwatch.llm.common import stored, table, text_or_empty
from wardwatch.llm.encoding import encoder

LENGTH = 1024
END = 2  # id after each document
GROUPS = 64  # of equal cardinality
SMALL = (0.4, 0.2, 0.1)  # pieces up to this part of a sequence are small; the one with the fewest sequences counts
PIECE_COLUMNS = "piece int, start long, length long, ids_crc32 long, part int, at long"
PIECE = [c.split()[0] for c in PIECE_COLUMNS.split(", ")]
PIECE_TYPES = [pa.int32() if c.endswith(" int") else pa.int64() for c in PIECE_COLUMNS.split(", ")]


# --- the plan, on a histogram ---------------------------------------------------------------------------------------


def linear_groups(histogram: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(rounded size, [(length, count), …])`` in falling order; all groups but the last have equal cardinality."""
    lengths = sorted(histogram, reverse=True)
    each = max(1, -(-sum(histogram.values()) // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in lengths:
        left = histogram[length]
        while left:
            if not room:
                out.append((length, []))
                room = each
            some = min(left, room)
            out[-1][1].append((length, some))
            left, room = left - some, room - some
    merged: dict[int, list[tuple[int, int]]] = {}
    for size, members in out:  # groups that round up to the same size are one
        merged.setdefault(size, []).extend(members)
    return list(merged.items())


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits (unbounded knapsack)."""
    worth = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth[room], choice[room] = worth[room - 1], -1
        fits = sizes <= room
        if fits.any():
            totals = np.where(fits, worth[np.maximum(room - sizes, 0)] + values, -1.0)
            best = int(totals.argmax())
            if totals[best] > worth[room] + 1e-12:
                worth[room], choice[room] = totals[best], best
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(worth[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns of the sizes and how often the best fractional packing uses them (column generation)."""
    size, need = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag(capacity // size).astype(float)
    for _ in range(60 * len(sizes)):
        use = np.linalg.solve(basis, need)
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, pattern = best_pattern(size, duals, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        up = direction > 1e-9
        ratio = np.where(up, np.maximum(use, 0) / np.where(up, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    use = np.maximum(np.linalg.solve(basis, need), 0)
    return [(basis[:, i].round().astype(np.int64), float(use[i])) for i in range(len(sizes))]


class Bins:
    """Classes of sequences with the same content: ``room -> [(count, content)]``, content being (length, first rank)s."""

    def __init__(self, capacity: int):
        self.by_room: dict[int, list[tuple[int, tuple]]] = {}
        self.rooms: list[int] = []
        self.capacity = capacity

    def add(self, room: int, count: int, content: tuple) -> None:
        if room not in self.by_room:
            self.by_room[room] = []
            bisect.insort(self.rooms, room)
        self.by_room[room].append((count, content))

    def total(self) -> int:
        return sum(count for classes in self.by_room.values() for count, _ in classes)

    def put(self, length: int, rank: int, count: int) -> None:
        """Best fit: each piece goes where the least room is left; new sequences when nothing fits."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                whole = count // each
                if whole:
                    content = tuple((length, rank + i * whole) for i in range(each))
                    self.add(self.capacity - each * length, whole, content)
                if count % each:
                    left = count % each
                    start = rank + whole * each
                    self.add(self.capacity - left * length, 1, tuple((length, start + i) for i in range(left)))
                return
            room = self.rooms[at]
            many, content = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms.pop(at)
            some = min(many, count)
            if some < many:
                self.add(room, many - some, tuple((n, r + some) for n, r in content))
            self.add(room - length, some, content + ((length, rank),))
            rank, count = rank + some, count - some


def plan(histogram: dict[int, int], capacity: int = LENGTH, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> pd.DataFrame:
    """``length, rank, sequence, offset``: from this rank on, pieces of a length go to sequences from this number on.

    A low border fits lengths that occur very often to each other; a high one has finer groups where lengths are spread.
    """
    return laid_out(min((filled(histogram, capacity, groups, part) for part in small), key=Bins.total))


def filled(histogram: dict[int, int], capacity: int, groups: int, small: float) -> Bins:
    bins, taken = Bins(capacity), dict.fromkeys(histogram, 0)
    border = int(capacity * small)
    large = {n: c for n, c in histogram.items() if border < n < capacity}
    if large:
        grouped = linear_groups(large, groups)
        rows = [[list(m) for m in members] for _, members in grouped]
        demand = [sum(c for _, c in members) for members in rows]
        for pattern, use in configurations([size for size, _ in grouped], demand, capacity):
            place(bins, rows, pattern, int(use + 1e-9), taken, capacity)
        left: dict[int, int] = {}
        for members in rows:
            for n, c in members:
                left[n] = left.get(n, 0) + c
        for n in sorted(left, reverse=True):
            if left[n]:
                bins.put(n, taken[n], left[n])
                taken[n] += left[n]
    for n in sorted(histogram, reverse=True):
        if n <= border or n >= capacity:
            bins.put(n, taken[n], histogram[n])
    return bins


def place(bins: Bins, rows: list, pattern: np.ndarray, times: int, taken: dict[int, int], capacity: int) -> None:
    """Put actual lengths into the places of a pattern; runs of sequences with the same lengths are one class."""
    slots = [g for g, c in enumerate(pattern) for _ in range(c)]
    while times > 0:
        runs = {g: slots.count(g) for g in slots}
        if any(not rows[g] or sum(c for _, c in rows[g]) < k for g, k in runs.items()):
            return
        chosen, uses = [], {}
        for g, k in runs.items():
            i = 0
            while k:
                n, c = rows[g][i]
                some = min(k, c)
                chosen.append((n, some))
                uses[g, i] = some
                k, i = k - some, i + 1
        some = min([times, *(rows[g][i][1] // k for (g, i), k in uses.items())])
        content = []
        for n, k in chosen:
            for _ in range(k):
                content.append((n, taken[n]))
                taken[n] += some
        bins.add(capacity - sum(n for n, _ in content), some, tuple(content))
        for (g, i), k in uses.items():
            rows[g][i][1] -= k * some
        for g in runs:
            rows[g][:] = [m for m in rows[g] if m[1]]
        times -= some


def laid_out(bins: Bins) -> pd.DataFrame:
    out, number = [], 0
    for room in bins.rooms:
        for count, content in bins.by_room[room]:
            offset = 0
            for length, rank in content:
                out.append((length, rank, number, offset))
                offset += length
            number += count
    return pd.DataFrame(out, columns=["length", "rank", "sequence", "offset"], dtype="int64").sort_values(["length", "rank"])


# --- pieces and their places ----------------------------------------------------------------------------------------


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """``start, length`` of a document's pieces: full ones, the first one perhaps shorter."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((start, capacity) for start in range(first, total, capacity))]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece. ``part, at``: the task that made it, and its number among those of its length there."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        closing = np.array([end], dtype="<u4").tobytes()
        for batch, texts in text_slices(batches, "text"):
            rows, owners = [], []
            for number, ids in enumerate(encoder(tokenizer).ids([t.decode() for t in texts])):
                ids += closing
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    rows.append((i, start, length, crc, part, seen[length]))
                    owners.append(number)
                    seen[length] += 1
            columns = [batch.column("doc_id").take(pa.array(owners))]  # ids never leave Arrow: any type, null or not
            columns += [pa.array(values, t) for values, t in zip(np.array(rows, dtype=np.int64).T, PIECE_TYPES)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *PIECE])

    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(over, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECE_COLUMNS}")


def packed(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, end: int = END, groups: int = GROUPS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each row.

    A null text is empty and has the end token alone; repeated rows are packed as often as they occur; ids are carried along as
    they are, null or repeated.
    """
    pieces = stored(pieces_of(docs, tokenizer, capacity, end), "pieces")
    counts = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    recipe = plan(histogram, capacity, groups)
    span = max(histogram.values(), default=0) + 1
    keys = (recipe["length"] * span + recipe["rank"]).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((keys, recipe["sequence"].to_numpy(), recipe["offset"].to_numpy()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, offset = shared.value
        for batch in batches:
            key = batch.column("length").to_numpy() * span + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequence[at] + key - keys[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "piece-starts")
    ranks = pieces.join(starts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at")).alias("rank")
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ranks.mapInArrow(
        places, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
