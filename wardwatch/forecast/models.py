"""Forecast models over all series at once. Independent models are fitted side by side.

A model takes rows with ``is_train`` and the arrays of ``model_features`` and returns a long table
(series, variable, model_id, date, pred) with fitted values on training rows and predictions elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from wardwatch.forecast import arima, ets, hinges, solvers, trend
from wardwatch.forecast.evaluate import LAST_VALUE
from wardwatch.forecast.features import KEYS, LEVELS
from wardwatch.operators.reshape import rbind
from wardwatch.session import settle, together

ARIMA, ARIMA_BOOSTED, ETS, TREND_SEASONAL, LINEAR, HINGE = 1, 2, 3, 4, 5, 6
TREND_BOOSTED, FOREST, ARIMA_PLAIN, ELASTIC_NET = 7, 8, 9, 10
FACTORS = 11 + len(LEVELS)  # months but the first, and levels
SCHEMA = "series string, variable string, model_id int, date date, pred double"

Fit = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _matrix(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.array(rows[column].tolist(), dtype=float).reshape(len(rows), -1)


def _regression(column: str, solve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Fit:
    def fit(train: pd.DataFrame, rest: pd.DataFrame) -> np.ndarray:
        beta = solve(_matrix(train, column), train["value"].to_numpy())
        return _matrix(pd.concat([train, rest]), column) @ beta

    return fit


def _last_value(train: pd.DataFrame, rest: pd.DataFrame) -> np.ndarray:
    """Each day repeats the day before; the days after the last known one repeat it."""
    y = train["value"].to_numpy()
    return np.concatenate([y[:1], y[:-1], np.full(len(rest), y[-1])])


PENALTY, MIXTURE = 0.01, 0.5  # of the elastic net
REGRESSIONS = {
    LINEAR: ("x_linear", solvers.least_squares),
    ELASTIC_NET: ("x_fourier", lambda x, y: solvers.elastic_net(x, y, PENALTY, MIXTURE)),
}
SOLVED: dict[int, Fit] = {LAST_VALUE: _last_value} | {m: _regression(*r) for m, r in REGRESSIONS.items()}
# The regressors that a model reads; no others are sent to its task.
ARRAYS = {m: column for m, (column, _) in REGRESSIONS.items()}


def _needed(rows: DataFrame, model_ids: list[int], *more: str) -> DataFrame:
    arrays = dict.fromkeys(ARRAYS[m] for m in model_ids if m in ARRAYS)
    return rows.select(*KEYS, "date", "value", "is_train", *more, *arrays)


def fit_solved(rows: DataFrame, model_ids: list[int]) -> DataFrame:
    """Fit the given per-series models; one shuffle by series serves them all.

    A series without a training row has no fitted values; ``best_model`` names its model.
    """

    def fit_series(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("date")
        known = series["is_train"].to_numpy(dtype=bool)
        train, rest = series[known], series[~known]
        if train.empty:
            return pd.DataFrame(columns=["series", "variable", "model_id", "date", "pred"])
        base = pd.concat([train, rest])[["series", "variable", "date"]]
        return pd.concat([base.assign(model_id=m, pred=SOLVED[m](train, rest)) for m in model_ids])[
            ["series", "variable", "model_id", "date", "pred"]
        ]

    return _needed(rows, model_ids).groupBy(*KEYS).applyInPandas(fit_series, SCHEMA)


def regression_weights(rows: DataFrame, model_id: int) -> DataFrame:
    """``KEYS, beta`` of a regression model: the coefficients of its regressors for each series with a training row."""
    column, solve = REGRESSIONS[model_id]

    def solve_series(series: pd.DataFrame) -> pd.DataFrame:
        beta = solve(_matrix(series, column), series["value"].to_numpy())
        return series[KEYS].head(1).assign(beta=[beta])

    known = rows.where(F.col("is_train")).select(*KEYS, "value", column)
    return known.groupBy(*KEYS).applyInPandas(solve_series, "series string, variable string, beta array<double>")


def fit_chosen(rows: DataFrame, model_ids: list[int]) -> DataFrame:
    """Predictions for the rows that are no training rows, by the one model that ``model_id`` names for the series.

    ``model_ids`` are the models that may occur. A model is fitted on the series that chose it.
    """
    rows = settle(rows)
    ahead = rows.where("NOT is_train").select(*KEYS, "date")
    chosen = {r["model_id"] for r in rows.select("model_id").distinct().collect()}  # at most one row for each model

    def ahead_of(model: int) -> DataFrame:
        own = rows.where(F.col("model_id") == model).drop("model_id")
        return settle(_fit_one(own, model).join(ahead, [*KEYS, "date"]))

    frames = together(*[partial(ahead_of, m) for m in model_ids if m in chosen])
    if not frames:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    return rbind(*frames).select("series", "variable", "model_id", "date", "pred")


def _with_scale(rows: DataFrame) -> DataFrame:
    """Mean and spread of each series' training values, so that one tree model can tell series apart."""
    window = Window.partitionBy(*KEYS)
    train = F.when(F.col("is_train"), F.col("value"))
    return rows.withColumns(
        {
            "series_mean": F.coalesce(F.avg(train).over(window), F.lit(0.0)),
            "series_sd": F.coalesce(F.stddev_pop(train).over(window), F.lit(0.0)),
        }
    )


def _fit_trees(rows: DataFrame, label: str, array: str, model) -> DataFrame:
    """Fit one distributed tree model over all series and add its ``prediction``.

    Training reads its rows dozens of times, so they are spread evenly and checkpointed first.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    rows = settle(rows.repartition(tasks, *KEYS, "date"))
    vectors = rows.withColumn("x", array_to_vector(array))
    assembler = VectorAssembler(inputCols=["x", "series_mean", "series_sd"], outputCol="features")
    model = model.setLabelCol(label).setFeaturesCol("features")
    fitted = Pipeline(stages=[assembler, model]).fit(vectors.filter(F.col("is_train") & F.col(label).isNotNull()))
    return fitted.transform(vectors)


def boost_residuals(rows: DataFrame, base: DataFrame, model_id: int, rounds: int = 15, depth: int = 6) -> DataFrame:
    """Add boosted trees on the residuals of a base model."""
    narrow = rows.select(*KEYS, "date", "value", "is_train", "x_linear")
    both = _with_scale(narrow).join(base.select(*KEYS, "date", F.col("pred").alias("base")), [*KEYS, "date"])
    both = both.withColumn("residual", F.col("value") - F.col("base"))
    trees = GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=0.015, minInstancesPerNode=2, seed=7)
    fitted = _fit_trees(both, "residual", "x_linear", trees)
    return fitted.select(
        *KEYS, F.lit(model_id).alias("model_id"), "date", (F.col("base") + F.col("prediction")).alias("pred")
    )


def _named(fitted: DataFrame, model_id: int) -> DataFrame:
    return fitted.select(*KEYS, F.lit(model_id).alias("model_id"), "date", "pred")


def fit_arima(rows: DataFrame) -> DataFrame:
    """With the restriction levels as regressors, the last columns of ``x_linear``."""
    levels = rows.withColumn("x", F.slice("x_linear", -len(LEVELS), len(LEVELS)))
    return _named(arima.arima(levels, len(LEVELS))[0], ARIMA)


def fit_arima_plain(rows: DataFrame) -> DataFrame:
    return _named(arima.arima(rows.withColumn("x", F.array().cast("array<double>")))[0], ARIMA_PLAIN)


def fit_ets(rows: DataFrame) -> DataFrame:
    return _named(ets.smooth(rows), ETS)


def fit_trend_seasonal(rows: DataFrame) -> DataFrame:
    return _named(trend.predict_trend(rows, trend.fit_trend(rows)), TREND_SEASONAL)


def fit_hinge(rows: DataFrame) -> DataFrame:
    return _named(hinges.fitted(hinges.hinge_rows(rows), FACTORS), HINGE)


def fit_arima_boosted(rows: DataFrame) -> DataFrame:
    return boost_residuals(rows, fit_arima(rows), ARIMA_BOOSTED)


def fit_trend_boosted(rows: DataFrame) -> DataFrame:
    return boost_residuals(rows, fit_trend_seasonal(rows), TREND_BOOSTED)


def fit_forest(rows: DataFrame, trees: int = 500, depth: int = 8) -> DataFrame:
    forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=50, seed=7)
    narrow = rows.select(*KEYS, "date", "value", "is_train", "x_fourier")
    fitted = _fit_trees(_with_scale(narrow), "value", "x_fourier", forest)
    return fitted.select(*KEYS, F.lit(FOREST).alias("model_id"), "date", F.col("prediction").alias("pred"))


OTHERS = {
    ARIMA: fit_arima, ARIMA_PLAIN: fit_arima_plain, ETS: fit_ets, TREND_SEASONAL: fit_trend_seasonal, HINGE: fit_hinge,
    ARIMA_BOOSTED: fit_arima_boosted, TREND_BOOSTED: fit_trend_boosted, FOREST: fit_forest,
}
BASES = {ARIMA_BOOSTED: ARIMA, TREND_BOOSTED: TREND_SEASONAL}


def fit_models(rows: DataFrame, model_ids: list[int]) -> DataFrame:
    """All given models as one long table. A boosted model takes its base from the others, if it is among them.

    Models do not depend on each other, but for a boosted one on its base: they are fitted side by side.
    """
    boosted = {m: b for m, b in BASES.items() if m in model_ids and b in model_ids}
    solved = [m for m in model_ids if m in SOLVED]
    rest = [m for m in model_ids if m not in solved and m not in boosted and m not in boosted.values()]

    def with_base(model: int) -> list[DataFrame]:
        base = settle(_fit_one(rows, boosted[model]))
        return [base, settle(boost_residuals(rows, base, model))]

    tasks = [partial(with_base, m) for m in boosted] + [lambda m=m: [settle(_fit_one(rows, m))] for m in rest]
    if solved:
        tasks.append(lambda: [settle(fit_solved(rows, solved))])
    return rbind(*[frame for frames in together(*tasks) for frame in frames])


def _fit_one(rows: DataFrame, model_id: int) -> DataFrame:
    return fit_solved(rows, [model_id]) if model_id in SOLVED else OTHERS[model_id](rows)


# --- closed forms -------------------------------------------------------------------------------


def fit_trend_line(rows: DataFrame) -> DataFrame:
    """A straight line per series by two aggregates."""
    day = F.unix_date("date").cast("double")
    window = Window.partitionBy(*KEYS)
    y, x = F.when(F.col("is_train"), F.col("value")), F.when(F.col("is_train"), day)
    line = F.regr_intercept(y, x).over(window) + F.regr_slope(y, x).over(window) * day
    return rows.select(*KEYS, F.lit(LINEAR).alias("model_id"), "date", line.alias("pred"))


def smoothed_level(rows: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Last level of simple exponential smoothing per series: a fold over its values in date order."""
    points = F.array_sort(F.collect_list(F.when(F.col("is_train"), F.struct("date", "value"))))
    values = F.transform(points, lambda p: p["value"])
    level = F.aggregate(
        F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))),
        F.get(values, F.lit(0)),
        lambda acc, v: alpha * v + (1 - alpha) * acc,
    )
    return rows.groupBy(*KEYS).agg(level.alias("level"))


def fit_smoothed(rows: DataFrame, alpha: float = 0.3) -> DataFrame:
    """The last level as forecast of all later rows."""
    level = smoothed_level(rows, alpha)
    return rows.filter(~F.col("is_train")).join(level, KEYS).select(
        *KEYS, F.lit(ETS).alias("model_id"), "date", F.col("level").alias("pred")
    )
