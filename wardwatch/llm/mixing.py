"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Every document gets an exponential key divided by its quality weight; the documents of a source in the order of their
keys are a weighted sample without replacement, whatever its length. A source whose target exceeds its size is taken in
complete epochs first; the rest of its budget is the prefix of that order, and the document on the border is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardwatch.llm.common import WORD, ranked, stored, table, text_or_empty

WEIGHTS = (3, 1, 2)  # of the sources by code point, repeating
SHARE = 1.5  # words of the mix for each word of the input
MOST = 2  # a source is taken so many times at most
SYMBOLS = r"[!|*&%$#@~^]"
LEAST_QUALITY = 0.05


def size_of() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def quality_of(size: Column) -> Column:
    """1 for texts without symbols, down to 0.05 for texts with a symbol for each word."""
    symbols = F.least(F.regexp_count(text_or_empty(), F.lit(SYMBOLS)).cast("long"), size)
    return F.when(size == 0, 1.0).otherwise(1.0 - (1.0 - LEAST_QUALITY) * symbols / size)


def uniform_of() -> Column:
    """A number between 0 and 1 that depends on a document's id and text alone."""
    content = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_or_empty())
    return (F.conv(F.substring(F.md5(content), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def measured(docs: DataFrame, keep: list[str], quality: str | None = None) -> DataFrame:
    """The columns to ``keep`` as a struct ``doc``, with ``size, key`` and the source as two columns without nulls.

    ``quality`` names a column with a weight between 0 and 1, such as a classifier's probability (null: 1); without one, symbols decide.
    """
    rows = docs.select(
        F.struct(*keep).alias("doc"), F.col("doc_id").alias("id"), F.col("source").isNull().alias("nameless"),
        F.coalesce("source", F.lit("")).alias("source"), size_of().alias("size"), uniform_of().alias("u"), "text",
        (F.lit(None) if quality is None else F.col(quality)).cast("double").alias("given"),
    )
    weight = quality_of(F.col("size")) if quality is None else F.least(F.greatest(F.coalesce("given", F.lit(1.0)), F.lit(LEAST_QUALITY)), F.lit(1.0))
    return rows.withColumn("key", -F.log("u") / weight).drop("u", "text", "given")


def targets_of(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` words of each row of ``sizes(nameless, source, source_size)``.

    Sources take their weights' shares; one that would pass ``most`` times its size stops there, and the excess goes to
    the others by weight, until none is above. Each round is one aggregate with one row; the level only rises.
    """
    order = [F.col("nameless"), F.col("source")]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(ranked(sizes, order, "place", "source-order").withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, above = share * (total[0] or 0), 0.0, None
    while total[0]:
        full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        held, rest, count = sources.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count(F.when(full, 1)),
        ).first()
        if count == above or not rest:
            break
        level, above = (budget - held) / rest, count
    full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(full, F.col("source_size") * float(most)).otherwise(F.lit(level) * F.col("weight")))


def mixed(
    docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
    quality: str | None = None,
) -> DataFrame:
    """``doc`` (a struct of the input's columns, or of those to ``keep``) with ``size, source_size, target, taken``.

    A null text has no words, a null source is a source of its own, a null ``doc_id`` a value like any other. Rows are
    ordered by key, id and size; rows equal in these are interchangeable, so reruns agree. A hot source is split into
    ranges of keys, whose sums are added up.
    """
    order = [F.col(c) for c in ("nameless", "source", "key", "id", "size")]
    named = measured(docs, docs.columns if keep is None else keep, quality)
    if keep is not None:  # dealing by range reads twice; narrow rows are cheaper written than measured again, whole documents are not
        named = stored(named, "measured")
    dealt = named.repartitionByRange(*order, F.monotonically_increasing_id())
    placed = stored(dealt.withColumn("part", F.spark_partition_id()), "placed")
    parts = stored(placed.groupBy("nameless", "source", "part").agg(F.sum("size").alias("words")), "part-sums")
    sizes = parts.groupBy("nameless", "source").agg(F.sum("words").alias("source_size"))
    targets = targets_of(sizes, weights, share, most)
    earlier = Window.partitionBy("nameless", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    starts = stored(
        parts.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(targets, ["nameless", "source"])
        .withColumn("epochs", F.when(F.col("source_size") == 0, 0).otherwise(F.floor(budget / F.col("source_size"))).cast("long"))
        .select("nameless", "source", "part", "start", "source_size", "target", "epochs", (budget - F.col("epochs") * F.col("source_size")).alias("rest")),
        "part-starts",
    )
    inside = Window.partitionBy("nameless", "source", "part").orderBy("key", "id", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("before")))
    return (
        placed.withColumn("before", before).join(starts, ["nameless", "source", "part"])
        .select("doc", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    )


def first_words(text: Column, count: Column) -> Column:
    """A text up to and with its word number ``count``; white space in front of the words is kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.concat_ws("", F.slice(pieces, F.lit(1), count.cast("int")))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the input's columns: a row for each time one is taken, the last one perhaps cut."""
    rows = mixed(docs, **options).where("taken > 0")
    times = F.expr("transform(sequence(1L, taken div size + CAST(taken % size > 0 AS BIGINT)), i -> CASE WHEN i <= taken div size THEN size ELSE taken % size END)")
    each = rows.select("doc", "size", F.explode(times).alias("words"))
    cut = F.when(F.col("words") < F.col("size"), first_words(F.col("doc.text"), F.col("words"))).otherwise(F.col("doc.text"))
    columns = []
    for name in docs.columns:
        value = F.col(f"doc.`{name}`")
        if name == "text":
            value = cut
        elif name == "n_chars":
            value = F.when(F.col("words") < F.col("size"), F.char_length(cut)).otherwise(value)
        columns.append(value.cast(docs.schema[name].dataType).alias(name))
    return each.select(*columns)


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Texts are measured and left behind."""
    rows = mixed(table(spark, folder, "documents"), keep=["doc_id"])
    return rows.select("doc.doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS x, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || x), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
        / 4503599627370496.0)
    / CASE WHEN size = 0 THEN 1.0::DOUBLE
        ELSE 1.0::DOUBLE - (1.0::DOUBLE - 0.05::DOUBLE)
          * least(CAST(len(regexp_extract_all(x, '[!|*&%$#@~^]')) AS BIGINT), size) / size END AS key
  FROM words),
sources AS (
  SELECT source, source_size, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source)),
stepped AS (
  SELECT *, 2.0 * source_size / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - 2 * (sum(source_size) OVER up - source_size))
      / (sum(weight) OVER () - sum(weight) OVER up + weight) AS level
  FROM sources WINDOW up AS (ORDER BY 2.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT max(level) FILTER (level < ratio) AS level FROM stepped),
targets AS (
  SELECT source, source_size, CASE WHEN 2 * source_size <= level * weight OR level IS NULL THEN 2.0::DOUBLE * source_size ELSE level * weight END AS target
  FROM sources, levels),
budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
    CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // source_size END AS epochs FROM targets)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size
    - (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size))) AS BIGINT) AS taken
FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
"""
