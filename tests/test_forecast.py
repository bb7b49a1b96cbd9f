"""Forecast features, solvers, accuracy and choice against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import forecasts
from catalog.base import REGISTRY
from wardwatch.forecast import evaluate, features as ft, models as md, run, solvers

START = dt.date(2020, 1, 1)


def series(spark, values, name="s", level=0):
    rows = [(name, "v", START + dt.timedelta(days=n), level, float(x)) for n, x in enumerate(values)]
    return spark.createDataFrame(rows, "series string, variable string, date date, lockdown_level int, value double")


def test_split_keeps_the_last_four_weeks(spark):
    df = ft.time_split(series(spark, range(100)))
    assert df.filter("NOT is_train").count() == 28
    assert df.filter("is_train").agg(F.max("date")).collect()[0][0] == START + dt.timedelta(days=71)


def test_future_dates_and_gaps(spark):
    df = series(spark, range(5))
    ahead = [r.date for r in ft.future_dates(df).orderBy("date").collect()]
    assert ahead[0] == START + dt.timedelta(days=5) and len(ahead) == 14
    by_gap = ft.future_dates_by_gap(df.filter(F.dayofmonth("date").isin(1, 4)), 3).orderBy("date").collect()
    assert [r.date.day for r in by_gap] == [4, 7, 10]


def test_line_is_found_again(spark):
    rows = ft.model_features(ft.time_split(series(spark, [3 + 0.5 * n for n in range(120)])))
    predicted = md.fit_models(rows, [md.LINEAR, md.ETS, md.ARIMA, md.HINGE])
    calibrated = evaluate.calibrate(rows, predicted)
    worst = {r.model_id: r.mae for r in evaluate.accuracy(calibrated).collect()}
    assert worst[md.LINEAR] < 1e-6 and worst[md.ARIMA] < 1e-6 and worst[md.ETS] < 8 and worst[md.HINGE] < 5


def test_every_model_predicts_every_row(spark):
    wave = [50 + 10 * np.sin(n / 20) + n % 3 for n in range(200)]
    rows = ft.model_features(ft.time_split(series(spark, wave, level=2)))
    ids = list(md.SOLVED)
    got = md.fit_models(rows, ids).groupBy("model_id").agg(F.count("pred").alias("n"), F.max(F.abs("pred")).alias("m")).collect()
    assert {r.model_id: r.n for r in got} == {m: 200 for m in ids}
    assert all(r.m < 500 for r in got)


def test_short_series_do_not_fail(spark):
    rows = ft.model_features(ft.time_split(series(spark, range(32))))
    assert md.fit_models(rows, list(md.SOLVED)).filter("pred IS NULL OR isnan(pred)").count() == 0


def test_accuracy_equals_brute_force(spark):
    actual, pred = np.array([4.0, 6.0, 5.0, 9.0]), np.array([5.0, 5.0, 5.5, 7.0])
    rows = [("s", "v", 1, START + dt.timedelta(days=n), float(a), float(p), float(a - p)) for n, (a, p) in enumerate(zip(actual, pred))]
    df = spark.createDataFrame(rows, "series string, variable string, model_id int, date date, actual double, pred double, residual double")
    got = evaluate.accuracy(df).collect()[0]
    miss = np.abs(actual - pred)
    assert got.mae == pytest.approx(miss.mean())
    assert got.mape == pytest.approx((miss / actual).mean() * 100)
    assert got.mase == pytest.approx(miss.mean() / np.abs(np.diff(actual)).mean())
    assert got.smape == pytest.approx((miss / ((actual + pred) / 2)).mean() * 100)
    assert got.rmse == pytest.approx(np.sqrt((miss**2).mean()))
    assert got.rsq == pytest.approx(np.corrcoef(actual, pred)[0, 1] ** 2)


def test_best_model_skips_four_and_breaks_ties(spark):
    rows = [("s", "v", 4, 0.1, 1.0), ("s", "v", 6, 0.5, 1.0), ("s", "v", 5, 0.5, 1.0), ("s", "v", 1, None, 0.0),
            ("t", "v", 2, 0.9, 1.0), ("flat", "v", 1, None, 0.2), ("flat", "v", 2, None, 0.1), ("flat", "v", 3, None, None)]
    df = spark.createDataFrame(rows, "series string, variable string, model_id int, mase double, mae double")
    assert {r.series: r.model_id for r in evaluate.best_model(df).collect()} == {"s": 5, "t": 2, "flat": 2}
    every = spark.createDataFrame([("s", "v"), ("new", "v"), ("new", "v")], "series string, variable string")
    assert {r.series: r.model_id for r in evaluate.best_model(df, every).collect()} == {"s": 5, "new": evaluate.LAST_VALUE}


def test_every_series_has_a_forecast(spark):
    """Constant, ten days, one row, and one that stands still in its test span."""
    given = {"long": range(100), "constant": [4] * 100, "ten": range(10), "one": [7], "still": [*range(60), *[0] * 40]}
    frames = [series(spark, v, name).withColumnRenamed("value", "v") for name, v in given.items()]
    history = frames[0]
    for frame in frames[1:]:
        history = history.union(frame)
    result = run.create_forecasts(history.drop("variable"), ["v"])
    rows = result.forecast.collect()
    assert {n: sum(r.series == n for r in rows) for n in given} == dict.fromkeys(given, 14)
    assert all(r.value is not None and np.isfinite(r.value) for r in rows)
    assert {r.value for r in rows if r.series == "one"} == {7.0} and {r.conf_lo for r in rows if r.series == "one"} == {None}
    assert result.best.count() == len(given)


def test_fits_are_sent_only_what_they_read(spark):
    rows = ft.model_features(ft.time_split(series(spark, range(60))))
    plan = md.fit_solved(rows, [evaluate.LAST_VALUE])._jdf.queryExecution().optimizedPlan().toString()
    python = plan[plan.index("FlatMapGroupsInPandas") :].splitlines()[1]
    assert "x_linear" not in python and "x_trend" not in python and "x_fourier" not in python


def test_smoothing_fold_equals_a_loop(spark):
    values = [3.0, 8.0, 1.0, 4.0, 7.0] * 10
    level = values[0]
    for v in values[1:22]:
        level = 0.3 * v + 0.7 * level
    rows = ft.time_split(series(spark, values))
    assert md.smoothed_level(rows).collect()[0].level == pytest.approx(level)


def cleaned(spark, values, skip=()):
    rows = series(spark, values).filter(~F.datediff("date", F.lit(START)).isin(list(skip)))
    return {(r.date - START).days: r.clean for r in ft.clean_outliers(rows).collect()}


def test_outliers_are_bridged_and_the_rest_stays(spark):
    values = [10 + n % 3 for n in range(40)]
    values[20] = 900
    got = cleaned(spark, values)
    assert 9.5 < got[20] < 12.5 and all(got[n] == values[n] for n in range(40) if n != 20)
    line = [3.0 * n for n in range(60)]
    assert cleaned(spark, [*line[:30], -500, *line[31:]])[30] == pytest.approx(90)
    assert cleaned(spark, [7.0] * 30) == dict.fromkeys(range(30), 7.0) and cleaned(spark, [4, 9]) == {0: 4, 1: 9}


def test_a_weekly_pattern_is_no_outlier(spark):
    week = [0.0, 0, 0, 50, 0, 0, -20]
    values = [100 + 0.5 * n + week[n % 7] for n in range(90)]
    assert cleaned(spark, values) == pytest.approx(dict(enumerate(values)))
    spoiled = [*values[:45], 400.0, *values[46:]]  # day 45 is one with a peak
    assert cleaned(spark, spoiled)[45] == pytest.approx(values[45], abs=4) and cleaned(spark, values, skip=(20, 21, 22)).keys() == set(range(90)) - {20, 21, 22}


def test_local_lines_equal_a_fit_of_their_days(spark):
    rng = np.random.default_rng(12)
    days = sorted(rng.choice(80, 50, replace=False).tolist())
    values = rng.normal(size=80)
    rows = series(spark, values).filter(F.datediff("date", F.lit(START)).isin(days))
    got = {(r.date - START).days: r.line for r in ft.local_line(rows, "value", 10, "line").collect()}
    for d in days:
        near = [n for n in days if abs(n - d) <= 10]
        want = np.polyval(np.polyfit(near, values[near], 1), d) if len(near) > 1 else values[d]
        assert got[d] == pytest.approx(want)


def test_bands_widen_with_the_step(spark):
    rng = np.random.default_rng(9)
    rows = [("s", START + dt.timedelta(days=n), 0, float(v)) for n, v in enumerate(200 + np.cumsum(rng.normal(size=400)) * 3)]
    history = spark.createDataFrame(rows, "series string, date date, lockdown_level int, v double")
    result = run.create_forecasts(history, ["v"], [md.LINEAR, md.ETS], origins=10)
    width = [r.conf_hi - r.conf_lo for r in result.forecast.orderBy("date").collect()]
    assert len(width) == 14 and all(w > 0 for w in width) and np.mean(width[7:]) > np.mean(width[:7])
    level = run.refit_rows(ft.long_rows(history, ["v"]), history, 30, level=3).filter("NOT is_train")
    assert level.count() == 30 and {r.lockdown_level for r in level.collect()} == {3}


def test_trend_bends_where_the_series_does(spark):
    values = [50 + 0.4 * n - 1.2 * max(n - 150, 0) + [0, 2, 5, 1, 0, -3, -5][n % 7] for n in range(300)]
    rows = ft.model_features(ft.time_split(series(spark, values)))
    models = md.trend.fit_trend(rows)
    beta = np.array(models.first()["beta"])
    changes = beta[md.trend.FIRST_CHANGE : md.trend.FIRST_CHANGE + ft.CHANGEPOINTS]
    strong = np.flatnonzero(np.abs(changes) > 0.1 * np.abs(changes).max())
    assert len(strong) <= 4  # sparse
    both = md.trend.predict_trend(rows, models).join(rows, [*ft.KEYS, "date"])
    assert both.agg(F.max(F.abs(F.col("pred") - F.col("value")))).first()[0] < 10
    bands = md.trend.trend_bands(rows, models).orderBy("date").collect()
    width = [b.conf_hi - b.conf_lo for b in bands]
    assert len(width) == 28 and width == sorted(width) and width[-1] > width[0]
    again = md.trend.trend_bands(rows.repartition(5), models).orderBy("date").collect()
    assert [b.conf_hi for b in again] == pytest.approx([b.conf_hi for b in bands])


def test_solvers():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 3))])
    beta = np.array([2.0, 1.0, 0.0, -3.0])
    y = x @ beta
    assert np.allclose(solvers.least_squares(x, y), beta)
    assert np.allclose(solvers.elastic_net(x, y, 1e-6, 0.5), beta, atol=1e-3)
    sparse = solvers.elastic_net(x, y + rng.normal(size=300) * 0.01, 0.1, 1.0)
    assert abs(sparse[2]) < 1e-9 and abs(sparse[3]) > 2


def test_whole_forecast(spark):
    values = [20 + n * 0.2 + (n % 7) for n in range(150)]
    rows = [("s", START + dt.timedelta(days=n), int(n > 70), float(v)) for n, v in enumerate(values)]
    history = spark.createDataFrame(rows, "series string, date date, lockdown_level int, v double")
    result = run.create_forecasts(history, ["v"], [md.ARIMA, md.ETS, md.LINEAR, md.TREND_SEASONAL])
    forecast = result.forecast.orderBy("date").collect()
    assert len(forecast) == 14 and forecast[0].date == START + dt.timedelta(days=150)
    assert all(r.conf_lo < r.value < r.conf_hi for r in forecast)
    assert result.best.collect()[0].model_id != md.TREND_SEASONAL
    assert result.accuracy.count() == 4
    wide = evaluate.wide_forecast(result.forecast, ["v"])
    assert {"value_v", "conf_lo_v", "conf_hi_v"} < set(wide.columns)


def test_boosting_changes_a_patterned_residual(spark):
    values = [100 + (30 if START.replace(day=1).month == (START + dt.timedelta(days=n)).month else 0) + n % 5 for n in range(120)]
    rows = ft.model_features(ft.time_split(series(spark, values)))
    base = md.fit_arima(rows)
    boosted = md.boost_residuals(rows, base, md.ARIMA_BOOSTED, rounds=3, depth=3)
    assert boosted.count() == 120 and boosted.filter("pred IS NULL").count() == 0


@pytest.mark.parametrize("rows,penalty", [(5, 0.01), (60, 0.001), (400, 0.1), (400, 50.0)])
def test_elastic_net_meets_the_conditions_of_the_optimum(rows, penalty):
    rng = np.random.default_rng(rows)
    day = np.arange(rows)
    x = np.column_stack([np.ones(rows), day, day**2, np.sin(day / 9), np.zeros(rows), *[(day % 7 == k) for k in range(6)],
                         *[np.maximum(day - k, 0) for k in range(0, rows, max(rows // 6, 1))]]).astype(float)
    y = 5 + np.cos(day / 9) * 3 + rng.normal(size=rows)
    beta = solvers.elastic_net(x, y, penalty, 0.5)
    spread = x.std(axis=0)
    moving = spread > 1e-12
    z = (x - x.mean(axis=0)) / np.where(moving, spread, 1.0)
    scaled = np.where(moving, beta * spread, 0.0)
    pull = z.T @ (y - y.mean() - z @ scaled) / rows - penalty / 2 * scaled
    used = moving & (scaled != 0)
    assert np.allclose(pull[used], penalty / 2 * np.sign(scaled[used]), atol=1e-7)
    assert (np.abs(pull[moving & ~used]) <= penalty / 2 + 1e-7).all()
    assert (x @ beta).mean() == pytest.approx(y.mean())


def test_county_queries_use_all_nightly_models_and_all_counties(spark, monkeypatch):
    asked = []

    def forecast(history, variables, model_ids=run.NIGHTLY_MODELS):
        asked.append(set(model_ids))
        return run.Forecast(history.limit(0).select(*[F.lit(None).alias(c) for c in ("series", "variable", "date")], F.lit(0.0).alias("value")), None, None)

    def fit(rows, model_ids):
        fitted.append((rows.select("series").distinct().count(), model_ids))
        return rows

    fitted = []
    monkeypatch.setattr(forecasts.run, "create_forecasts", forecast)
    monkeypatch.setattr(forecasts.md, "fit_models", fit)
    for name in ("forecast_counties", "forecast_counties_dates", "fit_forest"):
        REGISTRY[name].run(spark, "/root/testdata/sf0.001")
    assert asked == [set(run.NIGHTLY_MODELS)] * 2
    assert fitted[0][0] > 1 and fitted[0][1] == [md.FOREST]
    assert "fitted_rows_boosted" in REGISTRY and REGISTRY["fitted_rows_boosted"].sql
