"""Quality classifier: evidence of the text, shrunk site posteriors, one decision for each document.

A logistic model of lexical features gives each text's log odds. Sites (the host, here ``source``) and paths within them
(here ``source`` and ``lang``) have a posterior rate of good documents: labelled documents count as they are labelled,
others by the model's probability. Each level is a Beta prior with the level above as its mean; its strength is estimated
from all sites by moments, so sites with few documents stay near the global rate. A document's posterior is its
own evidence with the global base rate replaced by its path's rate, its own contribution taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwatch.llm.common import stored, table, text_or_empty

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "shouting", "symbols", "bars", "digits", "punctuation", "repeats", "distinct",
    "line_words",
)
SAMPLE = 20_000  # labelled documents that the text model is fitted on, the first ones by a hash of id and text
THRESHOLD = 0.5
EDGE = 1e-6  # rates are kept so far from 0 and 1
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"*&%$#@~^_=+<>{}[]\\"
STOPS = b".,;:?"


def share(data: bytes, kind: bytes, of: int) -> float:
    return (len(data) - len(data.translate(None, kind))) / max(of, 1)


def features(text: str) -> list[float]:
    """Features of a whole text; those of a text without words are all zero."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = sum(map(len, words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        float(np.log1p(n)), size / n, sum(len(w) > 20 for w in words) / n, share(data, UPPER, size),
        data.count(b"!") / n, share(data, SYMBOLS, n), data.count(b"|") / n, share(data, DIGITS, size),
        share(data, STOPS, n), same / n, len(set(words)) / n, float(np.log1p(n / (1 + data.count(b"\n")))),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id, host, lang, features`` and ``mark``, a hash of id and text that orders the training sample."""
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(features=[features(t) for t in batch["text"]])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("lang"),
        F.xxhash64("doc_id", "text").alias("mark"), text_or_empty().alias("text"),
    )
    kept = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # a string keeps null ids apart from numbers in pandas
    made = kept.mapInPandas(over, "doc_id string, host string, lang string, mark long, features array<double>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def label_of(labels: DataFrame) -> DataFrame:
    """One label for each id: good if most of its rows say so (ties: good). Rows without an id or a label don't count."""
    votes = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    return votes.agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("label"))


def fit_text_model(labelled: DataFrame, sample: int = SAMPLE) -> LogisticRegressionModel | None:
    """A logistic model of the features; None when the labels do not hold both classes."""
    bounded = stored(labelled.where("label IS NOT NULL").orderBy("mark", "doc_id").limit(sample).select(array_to_vector("features").alias("features"), "label"), "labelled")
    kinds = bounded.agg(F.min("label"), F.max("label")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        return None
    return LogisticRegression(maxIter=100, regParam=1e-4, tol=1e-8).fit(bounded)


def log_odds(rate: Column) -> Column:
    inside = F.least(F.greatest(rate, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(inside / (1 - inside))


def strength(cells: DataFrame, mean: Column, rate_columns: tuple[str, str] = ("good", "n")) -> float:
    """The Beta prior's strength by moments (Kleinman): how far rates vary around their mean beyond chance."""
    good, n = map(F.col, rate_columns)
    rate = good / n
    row = cells.where(n > 0).agg(
        F.sum(n).alias("n"), F.sum(n * (rate - mean) ** 2).alias("spread"), F.sum(n * mean * (1 - mean)).alias("chance"),
        F.count(F.lit(1)).alias("cells"), F.sum(n * n).alias("squares"),
    ).first()
    free = (row["cells"] or 0) - 1
    if free <= 0 or not row["chance"]:
        return 1.0
    one = row["chance"] / row["n"]
    below = one * (row["n"] - row["squares"] / row["n"] - free)
    rho = (row["spread"] - free * one) / below if below > 0 else 0.0
    rho = min(max(rho, 1e-4), 0.999)
    return 1 / rho - 1


def site_rates(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Per path ``host, lang, good, n, host_rate``, then the global rate and the strengths of host and path level.

    ``scored(host, lang, p)``: ``p`` is the label, or else the model's probability. Null hosts and langs are cells of
    their own. All levels come from one grouped aggregation that is combined before the shuffle.
    """
    paths = stored(scored.groupBy("host", "lang").agg(F.sum("p").alias("good"), F.count("p").alias("n")), "paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    overall = min(max(total[0] / total[1], EDGE), 1 - EDGE) if total[1] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    hosts = stored(hosts, "hosts")
    at_host = strength(hosts, F.lit(overall), ("host_good", "host_n"))
    rate = (F.col("host_good") + at_host * overall) / (F.col("host_n") + at_host)
    named = hosts.select(F.col("host").alias("h"), rate.alias("host_rate"), "host_good", "host_n")
    joined = stored(paths.join(named, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "path-rates")
    return joined, overall, at_host, strength(joined, F.col("host_rate"))


def posterior(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``host_rate, path_rate, probability, kept`` for each row of ``scored(host, lang, evidence, p)``."""
    paths, overall, at_host, at_path = site_rates(scored)
    named = paths.withColumnsRenamed({"host": "h", "lang": "l", "host_rate": "whole_rate"})
    both = scored.join(named, F.col("host").eqNullSafe(F.col("h")) & F.col("lang").eqNullSafe(F.col("l")), "left")
    own = F.col("p")
    host_rate = (F.col("host_good") - own + at_host * overall) / (F.col("host_n") - 1 + at_host)
    path_rate = (F.col("good") - own + at_path * F.col("host_rate")) / (F.col("n") - 1 + at_path)
    odds = F.col("evidence") + log_odds(F.col("path_rate"))
    return (
        both.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
        .withColumn("probability", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("probability") >= threshold)
        .drop("h", "l", "good", "n", "whole_rate", "host_good", "host_n")
    )


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, host, lang, mark, evidence, host_rate, path_rate, probability, kept`` for each document.

    ``evidence`` is the text's log odds against the sample's base rate. Texts without words, and all texts when the
    labels hold one class only, have evidence 0 and are judged by their site.
    """
    made = stored(with_features(docs), "features")
    known = stored(label_of(labels).withColumnRenamed("doc_id", "labelled_id"), "known")
    rows = made.join(known, F.col("doc_id") == F.col("labelled_id"), "left").drop("labelled_id")
    model = fit_text_model(rows, sample)
    empty = F.element_at("features", 1) == 0
    if model is None:
        base = 0.5 if rows.where("label IS NOT NULL").isEmpty() else rows.agg(F.avg("label")).first()[0]
        chance = F.lit(float(base))
        evidence = F.lit(0.0)
        scored = rows
    else:
        base = float(model.summary.predictions.agg(F.avg("label")).first()[0])
        scored = model.transform(rows.withColumn("vector", array_to_vector("features")).withColumnRenamed("features", "raw").withColumnRenamed("vector", "features"))
        scored = scored.withColumn("margin", vector_to_array("rawPrediction")[1]).withColumnRenamed("features", "vector").withColumnRenamed("raw", "features")
        evidence = F.when(empty, 0.0).otherwise(F.col("margin") - float(np.log(base / (1 - base))))
        chance = F.when(empty, float(base)).otherwise(1 / (1 + F.exp(-F.col("margin"))))
    scored = scored.select(
        "doc_id", "host", "lang", "mark", evidence.alias("evidence"), F.coalesce("label", chance).alias("p"),
    )
    return posterior(stored(scored, "scored"), threshold).drop("p")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all their columns. Rows equal in id and text share the decision of one site
    if they name the same host and lang."""
    verdicts = judged(docs, labels, **options).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("lang").alias("__lang"), F.col("mark").alias("__mark")
    ).distinct()
    rows = docs.select(
        F.struct("*").alias("__doc"), F.col("doc_id").alias("__a"), F.col("source").alias("__b"), F.col("lang").alias("__c"),
        F.xxhash64("doc_id", "text").alias("__d"),
    )
    on = (
        (F.col("__d") == F.col("__mark")) & F.col("__a").eqNullSafe(F.col("__id"))
        & F.col("__b").eqNullSafe(F.col("__host")) & F.col("__c").eqNullSafe(F.col("__lang"))
    )
    return rows.join(verdicts, on, "left_semi").select("__doc.*")


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on each document: evidence, posteriors of host and path, probability, kept."""
    return judged(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("mark")
