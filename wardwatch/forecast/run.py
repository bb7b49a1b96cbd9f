"""The forecast from day totals to the chosen model's bands."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from wardwatch.forecast import evaluate
from wardwatch.forecast.features import KEYS, future_rows, long_rows, model_features, spread, time_split
from wardwatch.forecast.models import ARIMA, ARIMA_BOOSTED, ETS, HINGE, LINEAR, TREND_SEASONAL, fit_chosen, fit_models
from wardwatch.operators.joins import forecast_context, lagged_regressors
from wardwatch.operators.reshape import rbind
from wardwatch.session import settle

NIGHTLY_MODELS = [ARIMA, ARIMA_BOOSTED, ETS, TREND_SEASONAL, LINEAR, HINGE]


class Forecast(NamedTuple):
    forecast: DataFrame
    accuracy: DataFrame
    best: DataFrame


def refit_rows(rows: DataFrame, history: DataFrame, days: int = 14, level: int | None = None, months: int | None = None) -> DataFrame:
    """All known rows as training rows, followed by the rows to forecast."""
    ahead = future_rows(rows, history, days, level, months).withColumn("is_train", F.lit(False))
    return rbind(rows.withColumn("is_train", F.lit(True)), ahead)


def create_forecasts(
    history: DataFrame,
    variables: list[str],
    model_ids: list[int] = NIGHTLY_MODELS,
    days: int = 14,
    weeks: int = 4,
    origins: int = 0,
    level: int | None = None,
    months: int | None = None,
) -> Forecast:
    """Fit, score on the last ``weeks`` weeks, refit on all rows and forecast ``days`` days with the best model.

    Every series has a forecast, and only its chosen model is fitted again. The day totals are written once, so that no model reads the facts again.
    With ``origins``, the chosen model is also fitted at so many earlier dates, and each step ahead has a band of its own; else one
    spread of the hold-out residuals serves all steps. ``level`` is a constant restriction level of the days ahead; ``months`` a horizon in
    calendar months instead of days.
    """
    history = settle(history)
    rows = long_rows(history, variables)
    split = settle(model_features(time_split(spread(rows), weeks)))
    calibrated = settle(evaluate.calibrate(split, fit_models(split, model_ids)))
    scores = evaluate.accuracy(calibrated)
    best = settle(evaluate.best_model(scores, rows))
    chosen = refit_rows(rows, history, days, level, months).join(best, KEYS)
    every = model_features(spread(chosen))
    refitted = fit_chosen(every, [evaluate.LAST_VALUE, *model_ids])
    if not origins:
        return Forecast(evaluate.with_bands(refitted, calibrated), scores, best)
    quantiles = evaluate.step_quantiles(rolling_residuals(rows, best, [evaluate.LAST_VALUE, *model_ids], origins, days))
    return Forecast(evaluate.with_step_bands(refitted, quantiles, rows), scores, best)


def rolling_residuals(rows: DataFrame, best: DataFrame, model_ids: list[int], origins: int, days: int) -> DataFrame:
    """Residuals of each series' chosen model at earlier origins. Origins with less than four weeks before them are left out."""
    first = rows.groupBy(*KEYS).agg(F.min("date").alias("first")).join(best, KEYS)
    past = evaluate.rolling_origins(rows.join(first, KEYS), origins, days=days)
    known = settle(model_features(spread(past.where(F.to_date(F.substring("series", 1, 10)) >= F.date_add("first", 27)).drop("first"))))
    return evaluate.calibrate(known, fit_chosen(known, model_ids))


CONTEXT = ["sum_newCases", "lockdown_level", "mean_7dIncidence"]


def forecast_with_context(forecast: DataFrame, history: DataFrame, days: int = 14, columns: list[str] = CONTEXT) -> DataFrame:
    """The forecast with the regressors of its dates: as they were, or on later dates as they were ``days`` days before."""
    last = history.groupBy("series").agg(F.max("date").alias("last"))
    dates = forecast.select("series", "date").distinct().join(last, "series").where("date > last").drop("last")
    return forecast_context(forecast, history, lagged_regressors(dates, history, columns, days), columns)
