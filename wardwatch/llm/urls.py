"""URL filter: rules for hosts and paths, and gradient-boosted trees on lexical features for the rest.

The trees are trained from labelled URLs. Features are column expressions over the URL: lengths, depth, digit ratio,
entropy, numbers of parameters and separators, and, for two suffixes of the host, the share of labelled URLs to block,
shrunk to the global share where a suffix has few.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwatch.llm.common import stored, table

SAMPLE = 20_000  # labelled URLs that the trees are fitted on, the first ones by a hash
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 7
WEIGHT = 20.0  # labelled URLs of a suffix that count as much as the global share
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"),
)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://`` or for null."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does. ``rules`` is a list that fits in an expression."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def entropy(text: Column) -> Column:
    """Bits for each character."""
    kinds = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    part = F.transform(kinds, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.aggregate(part, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` with ``host, path``, the features named ``f_…`` and the host's suffixes ``last`` and ``site``."""
    url = F.coalesce("url", F.lit(""))
    host, path = split_url(F.col("url"))
    split = urls.withColumn("host", host).withColumn("path", path)
    h, p = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return split.withColumns({
        "f_length": F.length(url).cast("double"),
        "f_host": F.length(h).cast("double"),
        "f_path": F.length(p).cast("double"),
        "f_depth": count_of(p, "/[^/]"),
        "f_labels": count_of(h, r"[^.]+"),
        "f_digits": count_of(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "f_host_digits": count_of(h, "[0-9]") / F.greatest(F.length(h), F.lit(1)),
        "f_hyphens": count_of(h, "-"),
        "f_entropy": entropy(url),
        "f_host_entropy": entropy(h),
        "f_parameters": count_of(query, "[^&]+"),
        "f_separators": count_of(url, r"[^A-Za-z0-9]"),
        "f_escapes": count_of(url, "%[0-9A-Fa-f]{2}"),
        "f_fragment": F.contains(url, F.lit("#")).cast("double"),
        "f_secure": url.startswith("https").cast("double"),
        "f_extension": F.length(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)).cast("double"),
        "f_first": F.length(F.regexp_extract(p, "^/([^/]*)", 1)).cast("double"),
        "last": F.regexp_extract(h, r"([^.]*)$", 1),
        "site": F.regexp_extract(h, r"([^.]*\.?[^.]*)$", 1),
    })


def shares(labelled: DataFrame, suffix: str, overall: float) -> DataFrame:
    """The shrunk share of URLs to block for each value of a suffix; counted over all labelled URLs."""
    counted = labelled.groupBy(F.col(suffix).alias("key")).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    return stored(counted.select("key", ((F.col("bad") + WEIGHT * overall) / (F.col("n") + WEIGHT)).alias(f"f_{suffix}")), f"shares-{suffix}")


class Filter(NamedTuple):
    """A fitted filter; without a model all URLs get the one label that was there."""

    model: GBTClassificationModel | None
    suffixes: dict[str, DataFrame]
    overall: float
    features: list[str]

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` (made by ``lexical``) with ``bad``, the probability that a URL is to be blocked."""
        if self.model is None:
            return urls.withColumn("bad", F.lit(self.overall))
        rows = self.with_shares(urls)
        made = VectorAssembler(inputCols=self.features, outputCol="f__vector").transform(rows)
        scored = self.model.transform(made).withColumn("bad", vector_to_array("probability")[1])
        return scored.select(*urls.columns, "bad")

    def with_shares(self, urls: DataFrame) -> DataFrame:
        for suffix, known in self.suffixes.items():
            urls = urls.join(known, F.col(suffix) == F.col("key"), "left").drop("key")
            urls = urls.withColumn(f"f_{suffix}", F.coalesce(f"f_{suffix}", F.lit(self.overall)))
        return urls


def train(labelled: DataFrame, sample: int = SAMPLE) -> Filter:
    """Fit on ``labelled`` (made by ``lexical``, with ``label`` 1.0 for URLs to block)."""
    total = labelled.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    overall = float(total[0]) if total[0] is not None else 0.0
    features = sorted(c for c in labelled.columns if c.startswith("f_"))
    if total[0] is None or total[1] == total[2]:
        return Filter(None, {}, overall, features)
    suffixes = {suffix: shares(labelled, suffix, overall) for suffix in ("last", "site")}
    features += [f"f_{suffix}" for suffix in suffixes]
    plain = Filter(None, suffixes, overall, features)
    bounded = labelled.orderBy(F.xxhash64("url"), "url").limit(sample)
    rows = VectorAssembler(inputCols=features, outputCol="f__vector").transform(plain.with_shares(bounded))
    fitted = stored(rows.select("f__vector", "label").coalesce(1), "labelled-urls")
    trees = GBTClassifier(
        featuresCol="f__vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, maxBins=64
    )
    return Filter(trees.fit(fitted), suffixes, overall, features)


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad`` for each page. A rule decides where one fits, else the trees.

    A null or empty URL has no host and no path and is judged by the trees; repeated rows are judged alike. Without
    labels of both kinds the one there is (or allow) is given.
    """
    rows = lexical(pages.select("page_id", "url"))
    scored = train(lexical(labelled.select("url", "label")), sample).score(rows)
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad")


def labelled_by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``url, label`` of the pages whose URL a rule decides."""
    host, path = split_url(F.col("url"))
    split = pages.select("url", host.alias("host"), path.alias("path"))
    _, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return split.select("url", (verdict == "block").cast("double").alias("label")).where("label IS NOT NULL")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """URLs that the rules decide are the labelled ones; the trees judge the others."""
    pages = table(spark, folder, "pages")
    return judged(pages, labelled_by_rules(pages)).drop("bad")
