"""Hold-out accuracy, choice of the best model, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardwatch.forecast.features import KEYS
from wardwatch.operators.reshape import pivot_forecast_wide

# Fixed value: two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054
EXCLUDED_MODELS = (4,)
LAST_VALUE = 0  # the model of a series that no other can be scored on


def calibrate(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions next to the actual values of the test rows, with the residual."""
    test = rows.filter(~F.col("is_train")).select(*KEYS, "date", F.col("value").alias("actual"))
    both = predictions.join(test, [*KEYS, "date"]).dropna(subset=["actual"])
    return both.withColumn("residual", F.col("actual") - F.col("pred"))


def accuracy(calibrated: DataFrame) -> DataFrame:
    """mae, mape, mase, smape, rmse and rsq per series and model.

    mase compares with the error of repeating the day before within the test span.
    """
    step = Window.partitionBy(*KEYS, "model_id").orderBy("date")
    df = calibrated.withColumn("naive", F.abs(F.col("actual") - F.lag("actual").over(step)))
    miss, actual, pred = F.abs("residual"), F.col("actual"), F.col("pred")
    # Squared correlation by its parts: ``corr`` fails on a flat forecast in ANSI mode.
    shared, spread = F.covar_pop("actual", "pred"), F.var_pop("actual") * F.var_pop("pred")
    return df.groupBy(*KEYS, "model_id").agg(
        F.avg(miss).alias("mae"),
        (F.avg(F.try_divide(miss, F.abs(actual))) * 100).alias("mape"),
        F.try_divide(F.avg(miss), F.avg("naive")).alias("mase"),
        (F.avg(F.try_divide(miss, (F.abs(actual) + F.abs(pred)) / 2)) * 100).alias("smape"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        F.try_divide(shared * shared, F.when(spread > 1e-12, spread)).alias("rsq"),
    )


def best_model(
    scores: DataFrame, series: DataFrame | None = None, excluded: tuple[int, ...] = EXCLUDED_MODELS
) -> DataFrame:
    """The model with the smallest mase per series, then mae (both null last), then number.

    mase is null where the series does not move in its test span. ``series`` has the keys of all series: one without
    any score, such as one shorter than the test span, gets the model that repeats the last value.
    """
    kept = scores.filter(~F.col("model_id").isin(list(excluded)))
    order = F.struct(F.col("mase").isNull(), "mase", F.col("mae").isNull(), "mae", "model_id")
    best = kept.groupBy(*KEYS).agg(F.min_by("model_id", order).alias("model_id"))
    if series is None:
        return best
    every = series.select(*KEYS).distinct()
    return every.join(best, KEYS, "left").withColumn("model_id", F.coalesce("model_id", F.lit(LAST_VALUE)))


def with_bands(predictions: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Point forecast and 95 % band from the spread of the hold-out residuals."""
    spread = calibrated.groupBy(*KEYS, "model_id").agg(F.stddev_samp("residual").alias("sd"))
    joined = predictions.join(spread, [*KEYS, "model_id"], "left")
    return joined.select(
        *KEYS,
        "model_id",
        "date",
        F.col("pred").alias("value"),
        (F.col("pred") - Z95 * F.col("sd")).alias("conf_lo"),
        (F.col("pred") + Z95 * F.col("sd")).alias("conf_hi"),
    )


def rolling_origins(rows: DataFrame, origins: int = 12, every: int = 7, days: int = 14) -> DataFrame:
    """``rows`` as they were known at several origins, ``every`` days apart, each followed by ``days`` days to be forecast.

    The last origin lies ``days`` days before the series' last date. ``series`` is the origin and the name, so that every model fits each
    origin as a series of its own; ``of_origin`` takes the two apart. Origins without a row before them are left out.
    """
    back = F.transform(F.sequence(F.lit(0), F.lit(origins - 1)), lambda k: (days + k * every).cast("int"))
    last = rows.groupBy(*KEYS).agg(F.max("date").alias("last"))
    starts = rows.join(last, KEYS).select(*rows.columns, F.explode(F.transform(back, lambda k: F.date_sub("last", k))).alias("origin"))
    known = starts.where(F.col("date") <= F.date_add("origin", days)).withColumn("is_train", F.col("date") <= F.col("origin"))
    name = F.concat(F.date_format("origin", "yyyy-MM-dd"), F.lit(" "), F.col("series"))
    return known.withColumn("series", name).drop("origin")


def of_origin(rows: DataFrame) -> DataFrame:
    """The rows of ``rolling_origins`` under their own names, with ``origin`` and ``step``, the days from it."""
    named = rows.withColumns({"origin": F.to_date(F.substring("series", 1, 10)), "series": F.expr("substring(series, 12)")})
    return named.withColumn("step", F.datediff("date", "origin"))


def step_quantiles(calibrated: DataFrame, tail: float = 0.025) -> DataFrame:
    """``low, high`` of the residuals of each series, model and step over all origins, of ``calibrated`` rolling rows."""
    steps = of_origin(calibrated).groupBy(*KEYS, "model_id", "step")
    parts = F.percentile("residual", F.array(F.lit(tail), F.lit(1 - tail)))
    return steps.agg(F.count("residual").alias("origins"), parts.alias("q")).select(
        *KEYS, "model_id", "step", "origins", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")
    )


def with_step_bands(predictions: DataFrame, quantiles: DataFrame, rows: DataFrame) -> DataFrame:
    """Point forecast and the band of its step: the days after the last one of ``rows``. Null where no origin has that step."""
    last = rows.groupBy(*KEYS).agg(F.max("date").alias("last"))
    steps = predictions.join(last, KEYS).withColumn("step", F.datediff("date", "last"))
    joined = steps.join(quantiles, [*KEYS, "model_id", "step"], "left")
    return joined.select(
        *KEYS, "model_id", "date", F.col("pred").alias("value"),
        (F.col("pred") + F.col("low")).alias("conf_lo"), (F.col("pred") + F.col("high")).alias("conf_hi"),
    )


def select_best(forecast: DataFrame, best: DataFrame) -> DataFrame:
    return forecast.join(best, [*KEYS, "model_id"])


def wide_forecast(forecast: DataFrame, variables: list[str]) -> DataFrame:
    """One row per series and date with the forecast of each variable side by side."""
    return pivot_forecast_wide(forecast, variables, ["series", "date"])
