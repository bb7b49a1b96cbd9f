"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of all characters from U+0080 on, A-Z in lower case. Windows of ten
consecutive words of the test items, and whole items with fewer words, go into a hash set that every task holds. A task
scans the words of its documents: words the items do not have end a window; the hashes of the other windows are looked
up, and what is found is verified word by word. Documents are never shuffled.

The hash set is broadcast in blocks of a checked size. A larger set has several blocks; documents are then scanned once
for each, and what the blocks find is put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from wardwatch.llm.batches import lists, text_slices, with_columns
from wardwatch.llm.common import stored, table, text_or_empty

WIDTH = 10  # words of a window
LEAK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_PAIRS = 1_000_000  # windows with their items that are broadcast at once
BLOCK_BYTES = 256_000_000  # of their words
FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Bytes of UTF-8: A-Z to lower case, all that is no part of a word to a space.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
SPAN = StructType().add("start", "long").add("stop", "long")
FOUND = (
    StructType().add("n_words", "long").add("n_hit", "long").add("items", ArrayType(StringType()))
    .add("spans", ArrayType(SPAN)).add("cleaned", "binary")
)


class HashSet(NamedTuple):
    words: dict[bytes, int]  # numbered from 1
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by width: falling hashes, word numbers, first pair of each
    filters: dict[int, np.ndarray]  # by width: which leading bits of a hash occur
    items: np.ndarray  # of the pairs
    names: list[str]  # of the items, sorted


# --- the windows of the test items ----------------------------------------------------------------------------------


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LEAK_WORD), F.lit(0))


def windows_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct ``item, window`` (an array of words) of ``benchmark(item_id, text)``. A null id is the empty string."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_or_empty()).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    windows = F.transform(starts, lambda i: F.slice("w", i, F.lit(width)))
    return items.where(F.size("w") > 0).select("item", F.explode(windows).alias("window")).distinct()


def hashed(ids: np.ndarray, width: int) -> np.ndarray:
    """Of each row's (or each position's) ``width`` word numbers."""
    out = np.zeros(len(ids), dtype=np.uint64)
    for k in range(width):
        out = (out + ids[:, k]) * FACTOR
    return out ^ (out >> np.uint64(29))


def hash_set(pairs: list[tuple[str, list[str]]]) -> HashSet:
    """Of ``(item, window)``s."""
    names = sorted({item for item, _ in pairs})
    number = {item: i for i, item in enumerate(names)}
    words: dict[bytes, int] = {}
    held: dict[int, dict[tuple, list[int]]] = {}
    for item, window in pairs:
        key = tuple(words.setdefault(w.encode(), len(words) + 1) for w in window)
        held.setdefault(len(key), {}).setdefault(key, []).append(number[item])
    windows, filters, items = {}, {}, []
    for width, of_width in held.items():
        ids = np.array(list(of_width), dtype=np.uint64).reshape(-1, width)
        hashes = hashed(ids, width)
        order = np.argsort(hashes, kind="stable")
        sizes = np.array([len(x) for x in of_width.values()])
        chosen = list(of_width.values())
        first = len(items) + np.concatenate([[0], np.cumsum(sizes[order])])
        items += [i for at in order.tolist() for i in chosen[at]]
        windows[width] = hashes[order], ids[order], first
        bits = np.zeros(1 << filter_bits(len(ids)), dtype=bool)
        bits[hashes >> np.uint64(64 - filter_bits(len(ids)))] = True
        filters[width] = bits
    return HashSet(words, windows, filters, np.array(items, dtype=np.int64), names)


def filter_bits(count: int) -> int:
    return min(26, max(10, count.bit_length() + 4))


# --- the scan -------------------------------------------------------------------------------------------------------


def find(known: HashSet, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``width``, first words, and windows (numbers within the width) of the verified hits in a row of word numbers (0: unknown)."""
    rolling = np.zeros(len(ids), dtype=np.uint64)
    for width in range(1, max(known.windows, default=0) + 1):
        count = len(ids) - width + 1
        if count <= 0:
            return
        rolling = (rolling[:count] + ids[width - 1 :]) * FACTOR
        if width not in known.windows:
            continue
        hashes, rows, _ = known.windows[width]
        mixed = rolling ^ (rolling >> np.uint64(29))
        bits = known.filters[width]
        at = np.flatnonzero(bits[mixed >> np.uint64(64 - (len(bits).bit_length() - 1))])
        entry = np.searchsorted(hashes, mixed[at])
        while len(at):  # several windows may share a hash
            inside = entry < len(hashes)
            at, entry = at[inside], entry[inside]
            same = hashes[entry] == mixed[at]
            at, entry = at[same], entry[same]
            right = np.ones(len(at), dtype=bool)
            for k in range(width):
                right &= ids[at + k] == rows[entry, k]
            yield width, at[right], entry[right]
            entry = entry + 1


def scan_texts(known: HashSet, texts: list[bytes], clean: bool) -> dict[str, pa.Array]:
    plain = [t.translate(NORMAL) for t in texts]
    words = [p.split() for p in plain]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat: list[bytes] = []
    for some in words:
        flat += some
        flat.append(b"")  # no window goes past a document
    ids = np.fromiter(map(known.words.get, flat, repeat(0)), dtype=np.uint64, count=len(flat))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    for width, at, entry in find(known, ids):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + width, -1)
        first = known.windows[width][2]
        seen = np.unique((np.searchsorted(starts, at, side="right") - 1) * len(first) + entry)
        doc, entry = seen // len(first), seen % len(first)
        many = first[entry + 1] - first[entry]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs.append(np.stack([np.repeat(doc, many), known.items[np.repeat(first[entry], many) + inner]], axis=1))
    hit = np.cumsum(edges[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    named = np.unique(np.concatenate(pairs), axis=0)
    change = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    doc = np.searchsorted(starts, begin, side="right") - 1
    spans = np.stack([begin - starts[doc], end - starts[doc]], axis=1)
    many = np.bincount(doc, minlength=len(texts))
    cleaned: list[bytes | None] = [None] * len(texts)
    if clean:
        cleaned = list(texts)
        for d, some in zip(np.flatnonzero(many).tolist(), np.split(spans, np.cumsum(many[many > 0])[:-1])):
            cleaned[d] = without(texts[d], plain[d], some.tolist())
    return {
        "n_words": pa.array(sizes),
        "n_hit": pa.array(total[starts + sizes] - total[starts]),
        "items": lists(pa.array([known.names[i] for i in named[:, 1].tolist()], pa.string()), np.bincount(named[:, 0], minlength=len(texts))),
        "spans": lists(pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "stop"]), many),
        "cleaned": pa.array(cleaned, pa.binary()),
    }


def without(text: bytes, plain: bytes, spans: list[list[int]]) -> bytes:
    """The text without what stands from the first to the last word of each span."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", plain)]
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*kept, text[at:]])


def scanned(rows: DataFrame, known: HashSet, clean: bool) -> DataFrame:
    """``rows`` (whose column ``__text`` is binary) with what the hash set finds in it."""
    keep = [c for c in rows.columns if c != "__text"]
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "__text"):
            yield with_columns(batch, keep, scan_texts(shared.value, texts, clean))

    return rows.mapInArrow(over, StructType([*(rows.schema[c] for c in keep), *FOUND]))


def leaks(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, width: int = WIDTH, clean: bool = False,
    block_pairs: int = BLOCK_PAIRS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc`` (a struct of the columns of ``docs``, or of those to ``keep``) with ``n_words, n_hit, items, spans, cleaned``.

    ``items`` are the ids, as sorted strings, of the test items with windows in the text; ``spans`` the ranges of words
    inside such windows, merged; ``cleaned``, if asked for, the text's bytes without them. A null or empty text has no words, nor
    has an empty test table any windows. An item with a null id counts under the empty string; items that repeat an id are
    one. Each row of ``docs`` has one row, also where rows or ids repeat.
    """
    pairs = stored(windows_of(benchmark, width), "windows")
    count, size = pairs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.concat_ws(" ", "window")).cast("long"))).first()
    blocks = max(1, -(-count // block_pairs), -(-(size or 0) // block_bytes))
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("doc"), text_or_empty().cast("binary").alias("__text"))
    block = F.pmod(F.xxhash64("item", F.array_join("window", " ")), F.lit(blocks))

    def held(number: int) -> HashSet:  # at most a block's size comes to the driver
        return hash_set([(r["item"], r["window"]) for r in pairs.where(block == number).collect()])

    if blocks == 1:
        return scanned(rows, held(0), clean)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    found = [stored(scanned(rows.select("row", "__text"), held(b), False).where("n_hit > 0"), f"found-{b}") for b in range(blocks)]
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    joined = stored(
        every.groupBy("row").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"),
        ),
        "found",
    )
    empty = scanned(rows, hash_set([]), False).drop("n_hit", "items", "spans", "cleaned")
    spans = F.coalesce("spans", F.array().cast(ArrayType(SPAN)))
    whole = rows.select("row", "__text").join(empty, "row").join(joined, "row", "left").select(
        "doc", "n_words", F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"), "__text",
    )
    if not clean:
        return whole.drop("__text").withColumn("cleaned", F.lit(None).cast("binary"))
    keep_columns = [c for c in whole.columns if c != "__text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "__text"):
            spans = batch.column("spans").to_pylist()
            out = [without(t, t.translate(NORMAL), [[s["start"], s["stop"]] for s in some]) for t, some in zip(texts, spans)]
            yield with_columns(batch, keep_columns, {"cleaned": pa.array(out, pa.binary())})

    return whole.mapInArrow(cut, StructType([*(whole.schema[c] for c in keep_columns), FOUND["cleaned"]]))


def merged_spans(spans: Column) -> Column:
    """Ranges that touch or overlap as one. At most one list for each block and row is put together."""
    last = lambda done: F.element_at(done, -1)
    none = F.array().cast(ArrayType(SPAN))

    def add(done: Column, s: Column) -> Column:
        longer = F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["stop"], s["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(s))
        )

    return F.aggregate(F.array_sort(spans), none, add)


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", **options) -> DataFrame:
    """The documents with all their columns, without contaminated ``"documents"`` or without the ``"spans"`` that are.

    A document that is nothing but such spans stays with an empty text; null texts stay null.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove {remove!r}: spans or documents")
    rows = leaks(docs, benchmark, clean=remove == "spans", **options)
    if remove == "documents":
        return rows.where("n_hit = 0").select("doc.*")
    cut = F.when(F.col("n_hit") > 0, F.col("cleaned").cast("string")).otherwise(F.col("doc.text")).alias("text")
    return rows.select(*[cut if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def op11_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Null texts have no words; item ids are strings, a null one the empty string."""
    rows = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return rows.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
places AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM places),
wide AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
grams AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM wide),
hits AS (SELECT r, i, k, item_id FROM grams JOIN windows USING (k, g)),
marked AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY encode(item_id)) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(marked.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, marked.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""
