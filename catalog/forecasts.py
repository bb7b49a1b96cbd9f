"""Forecast inputs, features, models, accuracy and choice of model.

Ship dates move on by 7,300 days, so that the series span all restriction levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import standins as s
from catalog.base import CTES, Tables, query
from wardwatch.forecast import evaluate, features as ft, models as md, run
from wardwatch.functions.dates import restriction_level
from wardwatch.operators import joins
from wardwatch.operators.reshape import rbind
from wardwatch.plans import jobs, nightly, views
from wardwatch.session import scratch_path, settle
from wardwatch.sources import tables

SHIFT = 7300
VARIABLES = ["sum_covid", "sum_intub"]


def moved_icu(t: Tables) -> DataFrame:
    return s.icu_daily(t).withColumn("date", F.date_add("date", SHIFT))


def national_history(t: Tables) -> DataFrame:
    return nightly.forecast_input(moved_icu(t))


def county_history(t: Tables) -> DataFrame:
    """One series per county."""
    days = s.icu_clean(t).select(
        F.col("gemeinde").alias("series"),
        F.date_add("date", SHIFT).alias("date"),
        F.col("faelle_covid_aktuell").alias("sum_covid"),
        F.col("faelle_covid_aktuell_beatmet").alias("sum_intub"),
    )
    return days.dropna(subset=VARIABLES).withColumn("lockdown_level", restriction_level("date"))


def split_rows(t: Tables) -> DataFrame:
    return ft.time_split(ft.spread(ft.long_rows(county_history(t), VARIABLES)))


def two_models(rows: DataFrame) -> DataFrame:
    """The two models with a closed form."""
    line = md.fit_trend_line(rows).join(rows.filter(~F.col("is_train")).select(*ft.KEYS, "date"), [*ft.KEYS, "date"])
    return rbind(line, md.fit_smoothed(rows))


_LEVEL = """CAST(CASE WHEN date <= DATE '2020-03-23' THEN 0 WHEN date <= DATE '2020-05-03' THEN 3
    WHEN date <= DATE '2020-11-02' THEN 1 WHEN date <= DATE '2020-12-16' THEN 2 WHEN date <= DATE '2021-03-04' THEN 3
    WHEN date <= DATE '2021-04-19' THEN 2 WHEN date <= DATE '2021-05-01' THEN 1 WHEN date <= DATE '2021-08-07' THEN 0
    ELSE 1 END AS INTEGER)"""
CTES["fc_days"] = f"""
  SELECT *, {_LEVEL} AS lockdown_level
  FROM (SELECT gemeinde AS series, date + {SHIFT} AS date, faelle_covid_aktuell AS sum_covid,
               faelle_covid_aktuell_beatmet AS sum_intub FROM icu_clean)
  WHERE sum_covid IS NOT NULL AND sum_intub IS NOT NULL"""
CTES["fc_rows"] = """
  SELECT series, 'sum_covid' AS variable, date, lockdown_level, sum_covid AS value FROM fc_days
  UNION ALL SELECT series, 'sum_intub', date, lockdown_level, sum_intub FROM fc_days"""
CTES["fc_split"] = """
  SELECT *, date <= max(date) OVER (PARTITION BY series, variable) - 28 AS is_train FROM fc_rows"""
CTES["fc_line"] = """
  SELECT series, variable, 5 AS model_id, date, value, is_train,
         regr_intercept(y, x) OVER w + regr_slope(y, x) OVER w * day AS pred
  FROM (SELECT *, CAST(date - DATE '1970-01-01' AS DOUBLE) AS day, CASE WHEN is_train THEN value END AS y,
               CASE WHEN is_train THEN CAST(date - DATE '1970-01-01' AS DOUBLE) END AS x FROM fc_split)
  WINDOW w AS (PARTITION BY series, variable)"""
CTES["fc_level"] = """
  SELECT series, variable, sum(CASE WHEN i = 1 THEN 1 ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, n - i) * value) AS level
  FROM (SELECT *, row_number() OVER (PARTITION BY series, variable ORDER BY date) AS i,
               count(*) OVER (PARTITION BY series, variable) AS n FROM fc_split WHERE is_train)
  GROUP BY 1, 2"""
CTES["fc_calibrated"] = """
  SELECT series, variable, model_id, date, value AS actual, pred, value - pred AS residual
  FROM (SELECT series, variable, 5 AS model_id, date, value, pred FROM fc_line WHERE NOT is_train
        UNION ALL SELECT series, variable, 3, date, value, level FROM fc_split JOIN fc_level USING (series, variable)
        WHERE NOT is_train)"""
CTES["fc_accuracy"] = """
  SELECT series, variable, model_id, avg(abs(residual)) AS mae, avg(abs(residual) / nullif(abs(actual), 0)) * 100 AS mape,
         avg(abs(residual)) / nullif(avg(naive), 0) AS mase,
         avg(abs(residual) / nullif((abs(actual) + abs(pred)) / 2, 0)) * 100 AS smape,
         sqrt(avg(residual * residual)) AS rmse,
         pow(covar_pop(actual, pred), 2) / CASE WHEN var_pop(actual) * var_pop(pred) > 1e-12 THEN var_pop(actual) * var_pop(pred) END AS rsq
  FROM (SELECT *, abs(actual - lag(actual) OVER (PARTITION BY series, variable, model_id ORDER BY date)) AS naive
        FROM fc_calibrated)
  GROUP BY 1, 2, 3"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded columns; adding 0 turns a negative zero into a plain one."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query(
    f"""SELECT series, date, sum_intub, sum_covid, sum_newCases, sum_cumCases, {_LEVEL} AS lockdown_level,
         round(coalesce(m, lag(m) OVER (ORDER BY date)), 6) AS mean_7dIncidence
       FROM (SELECT 'national' AS series, date + {SHIFT} AS date,
               CASE WHEN count(faelle_covid_aktuell_beatmet) = count(*) THEN sum(faelle_covid_aktuell_beatmet) END AS sum_intub,
               CASE WHEN count(faelle_covid_aktuell) = count(*) THEN sum(faelle_covid_aktuell) END AS sum_covid,
               CAST(coalesce(sum(AnzFallErkrankung), 0) AS BIGINT) AS sum_newCases,
               CAST(coalesce(sum(KumFall), 0) AS BIGINT) AS sum_cumCases, avg(Incidence_7d_per_100k) AS m
             FROM icu_daily GROUP BY date)
       WHERE sum_intub IS NOT NULL AND sum_covid IS NOT NULL"""
)
def forecast_input(t: Tables) -> DataFrame:
    return rounded(national_history(t), "mean_7dIncidence")


@query("SELECT series, variable, date, lockdown_level, value, is_train FROM fc_split")
def time_split(t: Tables) -> DataFrame:
    return split_rows(t)


@query(
    """SELECT series, variable, date, CAST(month(date) AS INTEGER) AS month,
         round(coalesce((day - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 0), 6) AS date_num
       FROM (SELECT *, CAST(date - DATE '1970-01-01' AS DOUBLE) AS day,
                    CASE WHEN is_train THEN CAST(date - DATE '1970-01-01' AS DOUBLE) END AS x FROM fc_split)
       WINDOW w AS (PARTITION BY series, variable)"""
)
def calendar_features(t: Tables) -> DataFrame:
    df = ft.calendar_features(split_rows(t)).select("series", "variable", "date", "month", "date_num")
    return rounded(df, "date_num")


_WAVES = ", ".join(
    f"round({f}(CAST(date - DATE '1970-01-01' AS DOUBLE) * (2 * pi() * {k} / 365)), 6) + 0.0 AS {f}{k}"
    for k in range(1, 6) for f in ("sin", "cos")
)


@query(
    f"""SELECT date, {_WAVES}, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
          CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS mday,
          CAST(dayofweek(date) + 1 AS INTEGER) AS wday, CAST(dayofyear(date) AS INTEGER) AS yday,
          CAST(weekofyear(date) AS INTEGER) AS week
        FROM (SELECT DISTINCT date FROM fc_days)"""
)
def fourier_features(t: Tables) -> DataFrame:
    """Waves and date signature."""
    days = ft.date_signature(ft.fourier_features(county_history(t).select("date").distinct()))
    return rounded(days, *[f"{w}{k}" for k in range(1, 6) for w in ("sin", "cos")])


@query(
    """SELECT series, variable, CAST(last + CAST(step AS INTEGER) AS DATE) AS date
       FROM (SELECT series, variable, max(date) AS last, unnest(range(1, 15)) AS step FROM fc_rows GROUP BY 1, 2)"""
)
def future_dates(t: Tables) -> DataFrame:
    return ft.future_dates(ft.long_rows(county_history(t), VARIABLES))


@query(
    """SELECT series, variable, last + CAST(step * coalesce(gap, 1) AS INTEGER) AS date
       FROM (SELECT series, variable, max(date) AS last, arg_max(date - before, date) AS gap, unnest(range(0, 10)) AS step
             FROM (SELECT *, lag(date) OVER (PARTITION BY series, variable ORDER BY date) AS before FROM fc_rows)
             GROUP BY 1, 2)"""
)
def future_dates_by_gap(t: Tables) -> DataFrame:
    return ft.future_dates_by_gap(ft.long_rows(county_history(t), VARIABLES))


@query(
    """SELECT f.series, f.variable, f.date, d.lockdown_level, d.sum_covid
       FROM (SELECT series, variable, CAST(last + CAST(step AS INTEGER) AS DATE) AS date
             FROM (SELECT series, variable, max(date) AS last, unnest(range(1, 15)) AS step FROM fc_rows GROUP BY 1, 2)) f
       LEFT JOIN fc_days d ON d.series = f.series AND d.date + 14 = f.date"""
)
def lagged_regressors(t: Tables) -> DataFrame:
    history = settle(county_history(t))
    ahead = ft.future_dates(ft.long_rows(history, VARIABLES))
    return joins.lagged_regressors(ahead, history, ["lockdown_level", "sum_covid"])


@query("SELECT series, variable, 5 AS model_id, date, round(pred, 6) AS pred FROM fc_line")
def fit_trend_line(t: Tables) -> DataFrame:
    return rounded(md.fit_trend_line(split_rows(t)), "pred")


@query(
    """SELECT series, variable, last + CAST(step AS INTEGER) AS date,
              round(a + b * CAST(last + CAST(step AS INTEGER) - DATE '1970-01-01' AS DOUBLE), 6) AS pred
       FROM (SELECT series, variable, max(date) AS last, unnest(range(1, 15)) AS step,
                    regr_intercept(value, CAST(date - DATE '1970-01-01' AS DOUBLE)) AS a,
                    regr_slope(value, CAST(date - DATE '1970-01-01' AS DOUBLE)) AS b
             FROM fc_rows GROUP BY 1, 2)"""
)
def refit(t: Tables) -> DataFrame:
    """The line fitted again on all rows, two weeks ahead."""
    history = settle(county_history(t))
    every = run.refit_rows(ft.long_rows(history, VARIABLES), history)
    ahead = every.filter(~F.col("is_train")).select(*ft.KEYS, "date")
    return rounded(md.fit_trend_line(every).join(ahead, [*ft.KEYS, "date"]).drop("model_id"), "pred")


@query(
    """SELECT series, variable, CAST(date AS DATE) AS date, 3 AS lockdown_level, round(a + b * CAST(CAST(date AS DATE) - DATE '1970-01-01' AS DOUBLE), 6) AS pred
       FROM (SELECT series, variable, unnest(range(max(date) + INTERVAL 1 DAY, max(date) + INTERVAL 1 MONTH + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS date,
                    regr_intercept(value, CAST(date - DATE '1970-01-01' AS DOUBLE)) AS a,
                    regr_slope(value, CAST(date - DATE '1970-01-01' AS DOUBLE)) AS b
             FROM fc_rows GROUP BY 1, 2)"""
)
def month_ahead(t: Tables) -> DataFrame:
    """The refitted line over the next calendar month, under the strictest level throughout."""
    history = settle(county_history(t))
    every = run.refit_rows(ft.long_rows(history, VARIABLES), history, level=3, months=1)
    ahead = every.filter(~F.col("is_train")).select(*ft.KEYS, "date", "lockdown_level")
    return rounded(md.fit_trend_line(every).join(ahead, [*ft.KEYS, "date"]).drop("model_id"), "pred")


_SQL_INPUT = f"""SELECT 'national' AS series, date, sum_newCases, {_LEVEL} AS lockdown_level, coalesce(m, lag(m) OVER (ORDER BY date)) AS mean_7dIncidence
       FROM (SELECT date + {SHIFT} AS date, CAST(coalesce(sum(AnzFallErkrankung), 0) AS BIGINT) AS sum_newCases, avg(Incidence_7d_per_100k) AS m
             FROM icu_daily GROUP BY date HAVING count(faelle_covid_aktuell) = count(*) AND count(faelle_covid_aktuell_beatmet) = count(*))"""


@query(
    f"""WITH days AS ({_SQL_INPUT}), ahead AS (SELECT CAST(max(date) + CAST(step AS INTEGER) AS DATE) AS date FROM days, range(1, 15) AS s(step) GROUP BY step)
        SELECT a.date, d.sum_newCases, d.lockdown_level, round(d.mean_7dIncidence, 6) AS mean_7dIncidence, true AS has_value
        FROM ahead a LEFT JOIN days d ON d.date + 14 = a.date"""
)
def stored_forecast(t: Tables) -> DataFrame:
    """The national forecast as it is stored: next to new cases, level and incidence of fourteen days before."""
    root = scratch_path(t.spark, "forecast")
    jobs.store_forecast(national_history(t), root, "forecast", [md.LINEAR, md.ETS])
    rows = tables.read_table(t.spark, root, "forecast").withColumn("has_value", F.col("value_sum_covid").isNotNull() & F.col("conf_lo_sum_intub").isNotNull())
    return rounded(rows.select("date", *run.CONTEXT, "has_value"), "mean_7dIncidence")


@query("SELECT series, variable, round(level, 6) AS level FROM fc_level")
def smoothed_level(t: Tables) -> DataFrame:
    return rounded(md.smoothed_level(split_rows(t)), "level")


@query(
    """SELECT series, variable, model_id, date, actual, round(pred, 6) AS pred, round(residual, 6) AS residual
       FROM fc_calibrated"""
)
def calibrate(t: Tables) -> DataFrame:
    rows = settle(split_rows(t))
    return rounded(evaluate.calibrate(rows, two_models(rows)), "pred", "residual")


@query(
    """SELECT series, variable, model_id, round(mae, 6) AS mae, round(mape, 6) AS mape, round(mase, 6) AS mase,
              round(smape, 6) AS smape, round(rmse, 6) AS rmse, round(rsq, 6) AS rsq FROM fc_accuracy"""
)
def accuracy(t: Tables) -> DataFrame:
    rows = settle(split_rows(t))
    scores = evaluate.accuracy(evaluate.calibrate(rows, two_models(rows)))
    return rounded(scores, "mae", "mape", "mase", "smape", "rmse", "rsq")


@query(
    """SELECT series, variable, round(pow(covar_pop(actual, pred), 2) / CASE WHEN var_pop(actual) * var_pop(pred) > 1e-12 THEN var_pop(actual) * var_pop(pred) END, 6) AS rsq
       FROM fc_calibrated WHERE model_id = 5 GROUP BY 1, 2"""
)
def accuracy_rsq(t: Tables) -> DataFrame:
    """The share of explained variance, for the model whose forecast is not flat."""
    rows = settle(split_rows(t))
    scores = evaluate.accuracy(evaluate.calibrate(rows, two_models(rows))).filter("model_id = 5")
    return rounded(scores.select("series", "variable", "rsq"), "rsq")


@query(
    """SELECT series, variable, coalesce(model_id, 0) AS model_id FROM (SELECT DISTINCT series, variable FROM fc_rows) LEFT JOIN fc_accuracy USING (series, variable)
       QUALIFY row_number() OVER (PARTITION BY series, variable ORDER BY mase NULLS LAST, mae NULLS LAST, model_id) = 1"""
)
def best_model(t: Tables) -> DataFrame:
    """Every series has one."""
    rows = settle(split_rows(t))
    return evaluate.best_model(evaluate.accuracy(evaluate.calibrate(rows, two_models(rows))), rows)


_SQL_BEST = """SELECT series, variable, date, round(pred, 6) AS value, round(pred - 1.959963984540054 * sd, 6) AS conf_lo,
         round(pred + 1.959963984540054 * sd, 6) AS conf_hi
       FROM fc_calibrated
       JOIN (SELECT series, variable, model_id, stddev_samp(residual) AS sd FROM fc_calibrated GROUP BY 1, 2, 3)
         USING (series, variable, model_id)
       JOIN (SELECT series, variable, model_id FROM fc_accuracy
             QUALIFY row_number() OVER (PARTITION BY series, variable ORDER BY mase NULLS LAST, mae NULLS LAST, model_id) = 1)
         USING (series, variable, model_id)"""


def best_bands(t: Tables) -> DataFrame:
    rows = settle(split_rows(t))
    predictions = two_models(rows)
    calibrated = settle(evaluate.calibrate(rows, predictions))
    bands = evaluate.with_bands(predictions, calibrated)
    return evaluate.select_best(bands, evaluate.best_model(evaluate.accuracy(calibrated)))


@query(_SQL_BEST)
def forecast_with_bands(t: Tables) -> DataFrame:
    """Bands of the chosen model over the test span."""
    return rounded(best_bands(t).drop("model_id"), "value", "conf_lo", "conf_hi")


@query(
    f"""SELECT series, date,
         {', '.join(f"max({c}) FILTER (WHERE variable = '{v}') AS {c}_{v}" for v in ('sum_covid', 'sum_intub')
                    for c in ('value', 'conf_lo', 'conf_hi'))}
        FROM ({_SQL_BEST}) GROUP BY 1, 2"""
)
def pivot_forecast_wide(t: Tables) -> DataFrame:
    wide = evaluate.wide_forecast(best_bands(t), VARIABLES)
    return rounded(wide, *[c for c in wide.columns if c not in ("series", "date")])


@query(
    f"""SELECT b.series, b.variable, b.date, b.value, d.lockdown_level, d.sum_covid
        FROM ({_SQL_BEST}) b LEFT JOIN fc_days d ON d.series = b.series AND d.date = b.date
        UNION ALL
        SELECT f.series, f.variable, f.date, f.value, d.lockdown_level, d.sum_covid
        FROM (SELECT series, variable, CAST(last + CAST(step AS INTEGER) AS DATE) AS date,
                round(a + b * CAST(last + CAST(step AS INTEGER) - DATE '1970-01-01' AS DOUBLE), 6) + 0.0 AS value
              FROM (SELECT series, variable, max(date) AS last, unnest(range(1, 15)) AS step,
                      regr_intercept(value, CAST(date - DATE '1970-01-01' AS DOUBLE)) AS a,
                      regr_slope(value, CAST(date - DATE '1970-01-01' AS DOUBLE)) AS b
                    FROM fc_rows GROUP BY 1, 2)) f
        LEFT JOIN fc_days d ON d.series = f.series AND d.date + 14 = f.date"""
)
def forecast_context(t: Tables) -> DataFrame:
    """The forecast next to the regressors of its dates: the hold-out's best model, then the refitted line ahead."""
    history = settle(county_history(t))
    columns = ["lockdown_level", "sum_covid"]
    ahead = ft.future_dates(ft.long_rows(history, ["sum_covid"]))
    future = joins.lagged_regressors(ahead, history, columns)
    every = run.refit_rows(ft.long_rows(history, VARIABLES), history)
    later = every.filter(~F.col("is_train")).select(*ft.KEYS, "date")
    line = md.fit_trend_line(every).join(later, [*ft.KEYS, "date"]).select("series", "variable", "date", F.col("pred").alias("value"))
    past = best_bands(t).select("series", "variable", "date", "value")
    forecast = rounded(rbind(past, line), "value")
    return joins.forecast_context(forecast, history, future, columns)


def _local(column: str, source: str, name: str) -> str:
    """The line through the days around each date."""
    return f"""SELECT *, avg({column}) OVER near + coalesce(covar_pop({column}, CASE WHEN {column} IS NOT NULL THEN day END) OVER near
                 / nullif(var_pop(CASE WHEN {column} IS NOT NULL THEN day END) OVER near, 0), 0)
                 * (day - avg(CASE WHEN {column} IS NOT NULL THEN day END) OVER near) AS {name}
               FROM {source} WINDOW near AS (PARTITION BY series, variable ORDER BY day RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)"""


def _fence(line: str, source: str, name: str) -> str:
    return f"""SELECT *, adjusted - {line} BETWEEN q1 - 3 * (q3 - q1) - tiny AND q3 + 3 * (q3 - q1) + tiny AS {name}
               FROM (SELECT * EXCLUDE (q1, q3), quantile_cont(adjusted - {line}, 0.25) OVER w AS q1, quantile_cont(adjusted - {line}, 0.75) OVER w AS q3
                     FROM {source} WINDOW w AS (PARTITION BY series, variable))"""


CTES["co_adjusted"] = """
  SELECT *, value - pattern AS adjusted, 0.0 AS q1, 0.0 AS q3, 1e-9::DOUBLE * (max(abs(value)) OVER (PARTITION BY series, variable) + 1) AS tiny
  FROM (SELECT *, coalesce(quantile_cont(off, 0.5) OVER (PARTITION BY series, variable, day % 7), 0) AS pattern
        FROM (SELECT *, CASE WHEN count(value) OVER near = 7 THEN value - avg(value) OVER near END AS off
              FROM (SELECT *, CAST(date - DATE '1970-01-01' AS BIGINT) AS day FROM fc_rows)
              WINDOW near AS (PARTITION BY series, variable ORDER BY day RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)))"""
CTES["co_line"] = _local("adjusted", "co_adjusted", "line")
CTES["co_first"] = _fence("line", "co_line", "first")
CTES["co_again"] = _local("trusted", "(SELECT *, CASE WHEN first THEN adjusted END AS trusted FROM co_first)", "again")
CTES["co_good"] = _fence("again", "co_again", "good")


# Means of few whole numbers often end in an exact half; a little more than that rounds alike in both engines.
@query("SELECT series, variable, date, round(pattern + 0.00000003::DOUBLE, 6) + 0.0 AS pattern, round(line + 0.00000003::DOUBLE, 6) + 0.0 AS line FROM co_line")
def local_lines(t: Tables) -> DataFrame:
    """The weekly pattern and the line through the three weeks around each date, of the values without it."""
    rows = ft.weekly_pattern(ft.long_rows(county_history(t), VARIABLES)).withColumn("adjusted", F.col("value") - F.col("pattern"))
    lines = ft.local_line(rows, "adjusted", 10, "line")
    lines = lines.withColumns({c: F.col(c) + 3e-8 for c in ("pattern", "line")})
    return rounded(lines.select("series", "variable", "date", "pattern", "line"), "pattern", "line")


@query(
    """WITH d AS (SELECT *,
               last_value(CASE WHEN good THEN day END IGNORE NULLS) OVER p AS da, last_value(CASE WHEN good THEN adjusted END IGNORE NULLS) OVER p AS va,
               first_value(CASE WHEN good THEN day END IGNORE NULLS) OVER n AS db, first_value(CASE WHEN good THEN adjusted END IGNORE NULLS) OVER n AS vb
             FROM co_good WINDOW p AS (PARTITION BY series, variable ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                           n AS (PARTITION BY series, variable ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT series, variable, date, value,
              round(CASE WHEN good THEN value
                   ELSE coalesce(va + coalesce((vb - va) / nullif(db - da, 0), 0) * (day - da), va, vb) + pattern END, 6) + 0.0 AS clean
       FROM d"""
)
def clean_outliers(t: Tables) -> DataFrame:
    df = ft.clean_outliers(ft.long_rows(county_history(t), VARIABLES))
    return rounded(df, "clean").select("series", "variable", "date", "value", "clean")


CTES["fc_rolling"] = """
  SELECT r.series, r.variable, o.origin, r.date, r.value, r.date <= o.origin AS is_train, CAST(r.date - DATE '1970-01-01' AS DOUBLE) AS day
  FROM fc_rows r JOIN (SELECT series, variable, CAST(max(date) - CAST(14 + 7 * k AS INTEGER) AS DATE) AS origin FROM fc_rows, range(12) AS t(k) GROUP BY series, variable, k) o
    USING (series, variable) WHERE r.date <= o.origin + 14"""


@query(
    """WITH line AS (SELECT series, variable, origin, regr_intercept(value, day) AS a, regr_slope(value, day) AS b FROM fc_rolling WHERE is_train GROUP BY 1, 2, 3),
       level AS (SELECT series, variable, origin, sum(CASE WHEN i = 1 THEN 1 ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, n - i) * value) AS level
         FROM (SELECT *, row_number() OVER (PARTITION BY series, variable, origin ORDER BY date) AS i,
                 count(*) OVER (PARTITION BY series, variable, origin) AS n FROM fc_rolling WHERE is_train) GROUP BY 1, 2, 3),
       missed AS (SELECT series, variable, 5 AS model_id, origin, date, value - (a + b * day) AS residual FROM fc_rolling JOIN line USING (series, variable, origin) WHERE NOT is_train
         UNION ALL SELECT series, variable, 3, origin, date, value - level FROM fc_rolling JOIN level USING (series, variable, origin) WHERE NOT is_train)
       SELECT series, variable, model_id, CAST(date - origin AS INTEGER) AS step, count(*) AS origins,
         round(quantile_cont(residual, 0.975) - quantile_cont(residual, 0.025), 6) + 0.0 AS width, round(quantile_cont(residual, 0.025), 6) + 0.0 AS low
       FROM missed WHERE residual IS NOT NULL GROUP BY 1, 2, 3, 4"""
)
def bands_by_step(t: Tables) -> DataFrame:
    """How wide the band is for each step ahead, from the misses at twelve origins of the two models with a closed form."""
    past = settle(evaluate.rolling_origins(ft.long_rows(county_history(t), VARIABLES)))
    quantiles = evaluate.step_quantiles(evaluate.calibrate(past, two_models(past)))
    rows = quantiles.select(*ft.KEYS, "model_id", "step", "origins", (F.col("high") - F.col("low")).alias("width"), "low")
    return rounded(rows, "width", "low")


# --- fitted models: no SQL twin -----------------------------------------------------------------


def model_rows(t: Tables) -> DataFrame:
    return ft.model_features(split_rows(t))


def national_rows(t: Tables) -> DataFrame:
    return ft.model_features(ft.time_split(ft.spread(ft.long_rows(national_history(t), VARIABLES))))


@query()
def fit_linear(t: Tables) -> DataFrame:
    return md.fit_models(model_rows(t), [md.LINEAR])


@query()
def fit_arima(t: Tables) -> DataFrame:
    """With and without the level as regressor."""
    return md.fit_models(model_rows(t), [md.ARIMA, md.ARIMA_PLAIN])


@query()
def fit_ets(t: Tables) -> DataFrame:
    return md.fit_models(model_rows(t), [md.ETS])


@query()
def fit_trend_seasonal(t: Tables) -> DataFrame:
    return md.fit_models(model_rows(t), [md.TREND_SEASONAL])


@query()
def fit_hinge(t: Tables) -> DataFrame:
    return md.fit_models(model_rows(t), [md.HINGE])


@query()
def fit_elastic_net(t: Tables) -> DataFrame:
    return md.fit_models(model_rows(t), [md.ELASTIC_NET])


@query()
def fit_arima_boosted(t: Tables) -> DataFrame:
    return md.fit_models(model_rows(t), [md.ARIMA_BOOSTED])


@query()
def fit_trend_boosted(t: Tables) -> DataFrame:
    return md.fit_models(model_rows(t), [md.TREND_BOOSTED])


@query()
def fit_forest(t: Tables) -> DataFrame:
    return md.fit_models(model_rows(t), [md.FOREST])


@query()
def forecast_counties(t: Tables) -> DataFrame:
    """The chosen one of all six models for every county and variable, two weeks ahead."""
    return run.create_forecasts(county_history(t), VARIABLES).forecast


@query()
def forecast_national(t: Tables) -> DataFrame:
    """All six models on the national series."""
    return run.create_forecasts(national_history(t), VARIABLES).forecast


@query()
def forecast_accuracy(t: Tables) -> DataFrame:
    return run.create_forecasts(national_history(t), VARIABLES).accuracy


@query()
def forecast_cleaned(t: Tables) -> DataFrame:
    """Ten steps ahead from outlier-free series, with the 95 % band of the fitted residuals."""
    cleaned = settle(ft.clean_outliers(ft.long_rows(county_history(t), VARIABLES)))
    known = cleaned.select(*ft.KEYS, "date", "lockdown_level", F.col("clean").alias("value"), F.lit(True).alias("is_train"))
    ahead = ft.future_dates_by_gap(known, 11).join(known.select(*ft.KEYS, "date"), [*ft.KEYS, "date"], "left_anti")
    ahead = ahead.select(*ft.KEYS, "date", restriction_level("date").alias("lockdown_level"),
                         F.lit(None).cast("double").alias("value"), F.lit(False).alias("is_train"))
    every = ft.model_features(ft.spread(rbind(known, ahead)))
    fitted = settle(md.fit_models(every, [md.ARIMA_PLAIN]))
    seen = known.select(*ft.KEYS, "date", F.col("value").alias("actual"))
    residuals = fitted.join(seen, [*ft.KEYS, "date"]).withColumn("residual", F.col("actual") - F.col("pred"))
    return evaluate.with_bands(fitted.join(ahead.select(*ft.KEYS, "date"), [*ft.KEYS, "date"]), residuals)


@query()
def germany_icu_with_forecast(t: Tables) -> DataFrame:
    """National patients, new cases and forecast bands on one date axis."""
    result = run.create_forecasts(national_history(t), VARIABLES)
    wide = evaluate.wide_forecast(result.forecast, VARIABLES).drop("series")
    history = s.case_history(t).withColumn("date", F.date_add("date", SHIFT))
    icu = s.icu_clean(t).withColumn("date", F.date_add("date", SHIFT))
    return views.germany_icu_with_forecast(icu, history, wide)


# --- what fitted models must satisfy: SQL twins of their rules -----------------------------------


def fitted_rows(fitted: DataFrame) -> DataFrame:
    """Per series and model the number of rows and of finite predictions."""
    finite = F.col("pred").isNotNull() & ~F.isnan("pred") & (F.abs("pred") < 1e12)
    return fitted.groupBy(*ft.KEYS, "model_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("n_finite"))


def rows_twin(*model_ids: int) -> str:
    """Every row of every series that has a training row, once for each model."""
    ids = ", ".join(f"({m})" for m in model_ids)
    return f"""SELECT series, variable, model_id, n, n AS n_finite FROM
        (SELECT series, variable, count(*) AS n FROM fc_split GROUP BY 1, 2 HAVING bool_or(is_train)), (VALUES {ids}) AS m(model_id)"""


@query(rows_twin(md.ARIMA, md.ETS, md.TREND_SEASONAL, md.LINEAR, md.HINGE, md.ARIMA_PLAIN, md.ELASTIC_NET))
def fitted_rows_solved(t: Tables) -> DataFrame:
    """The models that a task fits to one series."""
    ids = [md.ARIMA, md.ETS, md.TREND_SEASONAL, md.LINEAR, md.HINGE, md.ARIMA_PLAIN, md.ELASTIC_NET]
    return fitted_rows(md.fit_models(model_rows(t), ids))


@query(rows_twin(md.ARIMA_BOOSTED, md.TREND_BOOSTED))
def fitted_rows_boosted(t: Tables) -> DataFrame:
    rows = settle(model_rows(t))
    return fitted_rows(md.fit_models(rows, [md.ARIMA_BOOSTED, md.TREND_BOOSTED]))


@query(
    """SELECT series, variable, count(*) AS n, true AS optimal FROM fc_split
       GROUP BY 1, 2 HAVING bool_or(is_train)"""
)
def linear_is_optimal(t: Tables) -> DataFrame:
    """The normal equations: training residuals are orthogonal to every regressor."""
    rows = settle(model_rows(t))
    both = rows.join(md.fit_models(rows, [md.LINEAR]), [*ft.KEYS, "date"])
    miss = F.when(F.col("is_train"), F.col("value") - F.col("pred")).otherwise(0.0)
    size = F.when(F.col("is_train"), F.abs("value") + 1).otherwise(0.0)
    each = both.select(*ft.KEYS, "date", miss.alias("r"), size.alias("s"), F.posexplode("x_linear").alias("axis", "x"))
    sums = each.groupBy(*ft.KEYS, "axis").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.sum(F.col("r") * F.col("x"))).alias("off"), F.sum(F.col("s") * (F.abs("x") + 1)).alias("scale")
    )
    return sums.groupBy(*ft.KEYS).agg(F.max("n").alias("n"), F.min(F.col("off") / F.col("scale") < 1e-9).alias("optimal"))


@query(
    """SELECT series, variable, CAST(last + CAST(step AS INTEGER) AS DATE) AS date, true AS has_value
       FROM (SELECT series, variable, max(date) AS last, unnest(range(1, 15)) AS step FROM fc_rows GROUP BY 1, 2)"""
)
def forecast_counties_dates(t: Tables) -> DataFrame:
    """Every series has a forecast for each of the fourteen days after its last one."""
    rows = run.create_forecasts(county_history(t), VARIABLES).forecast
    return rows.select(*ft.KEYS, "date", (F.col("value").isNotNull() & ~F.isnan("value")).alias("has_value"))
