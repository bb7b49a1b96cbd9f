"""Trend with sparse changes of slope, yearly and weekly waves and levels, for all series at once.

The most likely parameters under normal noise, Laplace changes of slope and wide normal priors on all others, by
reweighted ridge regression: products of all regressors come from one grouped aggregate, a task solves one series' small
system again and again until its weights stand still. Bands come from simulated paths with changes of slope as frequent and as
large as those found, seeded by the series' name, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwatch.forecast.arima import grouped_products
from wardwatch.forecast.evaluate import Z95
from wardwatch.forecast.features import CHANGEPOINTS, KEYS
from wardwatch.session import settle

SCALE_CHANGE, SCALE_OTHER = 0.05, 10.0  # of the priors, for values divided by the largest one
NEAR_ZERO = 1e-3  # where the Laplace prior's corner is rounded off
ROUNDS, STILL = 2000, 1e-11  # most reweightings, and how little the last one may move
PATHS = 200  # simulated
FIRST_CHANGE = 2  # place of the first change of slope among the regressors, behind a constant and the line
YEARLY = slice(FIRST_CHANGE + CHANGEPOINTS, FIRST_CHANGE + CHANGEPOINTS + 20)  # places of the yearly waves
YEARLY_FROM = 2 * 365  # days of training; shorter series have no yearly waves


def weights_of(beta: np.ndarray, yearly: bool) -> np.ndarray:
    """Curvature of the priors: of the rounded Laplace one for changes of slope, of a normal one for the others."""
    out = np.full(len(beta), SCALE_OTHER**-2)
    if not yearly:
        out[YEARLY] = 1e12
    change = slice(FIRST_CHANGE, FIRST_CHANGE + CHANGEPOINTS)
    out[change] = 1 / (SCALE_CHANGE * np.sqrt(beta[change] ** 2 + NEAR_ZERO**2))
    return out


def solved(gram: np.ndarray, n: float, yearly: bool) -> tuple[np.ndarray, float]:
    """Coefficients and variance of the noise. ``gram`` has the products of the regressors and, last, the scaled values."""
    x, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    beta, noise = np.zeros(len(xy)), max(yy / n, 1e-12)
    for _ in range(ROUNDS):
        before = beta
        beta = np.linalg.solve(x / noise + np.diag(weights_of(beta, yearly)), xy / noise)
        noise = max((yy - 2 * beta @ xy + beta @ x @ beta) / n, 1e-8)
        if np.abs(beta - before).max() <= STILL * max(1.0, np.abs(beta).max()):
            break
    return beta, noise


def fit_trend(rows: DataFrame) -> DataFrame:
    """``KEYS, n, scale, yearly, beta, noise`` of each series: of ``x_trend`` on the training values divided by the largest of them."""
    train = rows.where(F.col("is_train") & F.col("value").isNotNull())
    largest = F.max(F.abs("value")).over(Window.partitionBy(*KEYS))
    scaled = train.select(*KEYS, "date", "value", "x_trend", F.when(largest > 0, largest).otherwise(F.lit(1.0)).alias("scale"))
    size = 2 + CHANGEPOINTS + 26 + 3
    products = grouped_products(scaled.withColumn("f", F.concat("x_trend", F.array(F.col("value") / F.col("scale")))), "f", size + 1)
    span = F.datediff(F.max("date"), F.min("date"))
    scales = scaled.groupBy(*KEYS).agg(F.max("scale").alias("scale"), (span >= YEARLY_FROM).alias("yearly"))

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [solved(np.array(g).reshape(size + 1, size + 1), n, y) for g, n, y in zip(batch["gram"], batch["n"], batch["yearly"])]
            yield batch[[*KEYS, "n", "scale", "yearly"]].assign(beta=[b for b, _ in fits], noise=[s for _, s in fits])

    schema = "series string, variable string, n long, scale double, yearly boolean, beta array<double>, noise double"
    return settle(products.join(scales, KEYS).mapInPandas(over, schema))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def predict_trend(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``KEYS, date, pred`` for all rows of fitted series."""
    both = rows.select(*KEYS, "date", "x_trend").join(models.select(*KEYS, "scale", "beta"), KEYS)
    return both.select(*KEYS, "date", (dot(F.col("beta"), F.col("x_trend")) * F.col("scale")).alias("pred"))


def uniform(*parts) -> Column:
    """Between 0 and 1, decided by the series and ``parts`` alone."""
    return (F.pmod(F.xxhash64(*KEYS, *parts), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def trend_bands(rows: DataFrame, models: DataFrame, paths: int = PATHS, z: float = Z95) -> DataFrame:
    """``KEYS, date, value, conf_lo, conf_hi`` for the rows that are no training rows.

    On each path a day may change the slope, as often as ``CHANGEPOINTS`` in the part of the training span that has them, by a
    Laplace number of the mean size found. The band has the spread of the paths on each day and of the noise together.
    """
    train_date = F.when(F.col("is_train"), F.col("date"))
    spans = rows.groupBy(*KEYS).agg(F.min(train_date).alias("first"), F.max(train_date).alias("last"))
    changes = F.slice("beta", FIRST_CHANGE + 1, CHANGEPOINTS)
    size = F.aggregate(changes, F.lit(0.0), lambda s, b: s + F.abs(b)) / CHANGEPOINTS
    days = F.greatest(F.datediff("last", "first"), F.lit(1)).cast("double")
    known = models.join(spans, KEYS).select(
        *KEYS, "last", "noise", "scale", (size / days).alias("size"), (CHANGEPOINTS / (0.8 * days)).alias("rate")
    )
    ahead = rows.where("NOT is_train").select(*KEYS, "date").join(predict_trend(rows, models), [*KEYS, "date"]).join(known, KEYS)
    ahead = ahead.withColumn("step", F.datediff("date", "last"))
    most = ahead.groupBy(*KEYS).agg(F.max("step").alias("most"))
    walk = known.join(most, KEYS).select("*", F.explode(F.sequence(F.lit(1), F.lit(paths))).alias("path"))
    walk = walk.select("*", F.explode(F.sequence(F.lit(1), "most")).alias("step"))
    side = uniform("path", "step", F.lit(2)) - 0.5
    change = F.when(
        uniform("path", "step", F.lit(1)) < F.col("rate"), -F.col("size") * F.signum(side) * F.ln(F.greatest(1 - 2 * F.abs(side), F.lit(1e-12)))
    ).otherwise(F.lit(0.0))
    along = Window.partitionBy(*KEYS, "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    walk = walk.select(*KEYS, "path", "step", F.sum(change).over(along).alias("slope"))
    walk = walk.select(*KEYS, "step", F.sum("slope").over(along).alias("off"))
    around = walk.groupBy(*KEYS, "step").agg(F.avg(F.col("off") * F.col("off")).alias("spread"))
    reach = z * F.col("scale") * F.sqrt(F.col("noise") + F.col("spread"))
    return ahead.join(around, [*KEYS, "step"]).select(
        *KEYS, "date", F.col("pred").alias("value"), (F.col("pred") - reach).alias("conf_lo"), (F.col("pred") + reach).alias("conf_hi")
    )
