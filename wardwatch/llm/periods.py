"""Periodic runs of words by a dictionary of basic factors.

The factors of a text are its stretches of 1, 2, 4, … words; equal factors of one length have the same name, and the names
of a length follow from pairs of names of half the length. The occurrences of a factor of ``L`` words that follow each
other within twice that length lie in arithmetic progressions, and the step proposes a period: where a factor
at ``i`` occurs next at ``i + d``, ``L/2 < d <= L``, the words from ``i`` to ``i + d + L`` have the smallest period ``d``. Neighbouring
places with the same step extend to one run. A run of three periods ``d`` or more shows itself at exactly one length, the power of two
from ``d`` on, and there its places are all neighbours, so runs come out whole and once.

Names that occur once in a document have no longer factors that repeat; they are left behind, so that ordinary text costs a few levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from wardwatch.llm.batches import lists, text_slices, with_columns
from wardwatch.llm.common import WORD, table, text_or_empty

SHORTEST = 24  # words of a run
TIMES = 3  # periods in a run
RUN = StructType().add("start", "long").add("length", "long").add("period", "long")
FOUND = StructType().add("n_words", "long").add("runs", ArrayType(RUN)).add("best", RUN).add("collapsed", "string")


def runs_of(names: np.ndarray, stops: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """``start, length, period`` of all runs, by start and period.

    ``names`` are numbers of the words of one or several documents one after another; a name occurs in one document only.
    ``stops`` holds for each word the end of its document. ``times`` is 3 at least.
    """
    places, width, out = np.arange(len(names)), 1, []
    table_of = np.empty(len(names), dtype=np.int64)
    while len(places):
        order = np.argsort(names, kind="stable")
        sorted_names, at = names[order], places[order]
        same = sorted_names[1:] == sorted_names[:-1]
        gap = at[1:] - at[:-1]
        close = np.flatnonzero(same & (2 * gap > width) & (gap <= width))
        if len(close):
            first, step = at[close], gap[close]
            by_place = np.argsort(first)
            out.append(stretches(first[by_place], step[by_place], width, shortest, times))
        again = np.zeros(len(at), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        label = np.cumsum(np.concatenate([[0], ~same]))
        table_of.fill(-1)
        table_of[at[again]] = label[again]
        longer = np.flatnonzero(table_of >= 0)
        longer = longer[longer + 2 * width <= stops[longer]]
        longer = longer[table_of[longer + width] >= 0]
        names = table_of[longer] * len(table_of) + table_of[longer + width]
        places, width = longer, 2 * width
    runs = np.concatenate([np.zeros((0, 3), dtype=np.int64), *out])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(first: np.ndarray, step: np.ndarray, width: int, shortest: int, times: int) -> np.ndarray:
    """Neighbouring places with one step as runs that are long enough."""
    head = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1] + 1) | (step[1:] != step[:-1])]))
    last = first[np.concatenate([head[1:], [len(first)]]) - 1]
    start, period = first[head], step[head]
    length = last - start + period + width
    return np.stack([start, length, period], axis=1)[(length >= shortest) & (length >= times * period)]


def best_of(runs: list[list[int]]) -> dict[str, int] | None:
    """The run with the greatest length / period; of equal ones that with the smallest start, then period."""
    if not runs:
        return None
    start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return {"start": start, "length": length, "period": period}


def scan_texts(texts: list[bytes], shortest: int, times: int) -> dict[str, pa.Array]:
    words = [t.split() for t in texts]  # bytes: at ASCII blanks only
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    number: dict[bytes, int] = {}
    flat = [w for some in words for w in some]
    ids = np.fromiter((number.setdefault(w, len(number)) for w in flat), dtype=np.int64, count=len(flat))
    docs = np.repeat(np.arange(len(texts)), sizes)
    runs = runs_of(docs * (len(number) + 1) + ids, np.repeat(stops, sizes), shortest, times)
    edges = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    doc = docs[runs[:, 0]] if len(runs) else np.zeros(0, dtype=np.int64)
    runs[:, 0] -= starts[doc]
    many = np.bincount(doc, minlength=len(texts))
    best: list[dict | None] = [None] * len(texts)
    collapsed = [b" ".join(some) for some in words]
    bounds = np.concatenate([[0], np.cumsum(many)])
    for d in np.flatnonzero(many).tolist():
        best[d] = best_of(runs[bounds[d] : bounds[d + 1]].tolist())
        collapsed[d] = b" ".join([words[d][i] for i in np.flatnonzero(kept[starts[d] : stops[d]]).tolist()])
    fields = [pa.array(runs[:, i]) for i in range(3)]
    return {
        "n_words": pa.array(sizes),
        "runs": lists(pa.StructArray.from_arrays(fields, ["start", "length", "period"]), many),
        "best": pa.array(best, pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])),
        "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
    }


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """``doc`` (a struct of the columns of ``docs``, or of those to ``keep``) with ``n_words, runs, best, collapsed``.

    A run is a stretch of words with smallest period q and at least ``max(shortest, times * q)`` words that no neighbour
    extends. ``runs`` holds start, length and period by start, then period; ``best`` the one with the most periods (ties: smallest start,
    then period; null without runs); ``collapsed`` the words that no run contains after its first period, joined by one space. A null or
    empty text has no words and an empty ``collapsed``; each row has one row, also where rows or ids repeat.
    """
    if times < TIMES:
        raise ValueError("runs of fewer than three periods may not show at the length that proposes their period")
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("doc"), text_or_empty().cast("binary").alias("__text"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "__text"):
            yield with_columns(batch, ["doc"], scan_texts(texts, shortest, times))

    return rows.mapInArrow(over, StructType([rows.schema["doc"], *FOUND]))


def collapsed(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, the texts with runs collapsed; texts without runs stay as they are."""
    rows = periodic_runs(docs, **options)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("doc.text")).alias("text")
    return rows.select(*[text if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def looped(doc_id: Column, text: Column) -> Column:
    """The text, in which documents whose id has a CRC-32 divisible by ten repeat their words from some place on.

    With h that CRC, g = h / 10 and n words, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) / (3 + g % 8), in whole numbers. A null id leaves the text as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def repeat(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(w, lambda word, i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), repeat), 1)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Null texts have no words. Null ids get no repeated words."""
    docs = table(spark, folder, "documents").select("doc_id", looped(F.col("doc_id"), text_or_empty()).alias("text"))
    rows = periodic_runs(docs, keep=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return rows.select(
        "doc.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
