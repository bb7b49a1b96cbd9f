"""Knot search, autoregression and smoothing against plain versions and planted series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwatch.forecast import arima, ets, features as ft, hinges, models as md

START = dt.date(2020, 1, 1)


def frame(spark, named, test=14, skip=()):
    """One series for each name, its last ``test`` days to be forecast; ``skip`` are days that are not there."""
    rows = [(n, "v", START + dt.timedelta(days=i), 0, float(v), i < len(vs) - test) for n, vs in named.items() for i, v in enumerate(vs) if i not in skip]
    return spark.createDataFrame(rows, "series string, variable string, date date, lockdown_level int, value double, is_train boolean")


def predictions(fitted):
    out = {}
    for r in fitted.collect():
        out.setdefault(r["series"], {})[(r["date"] - START).days] = r["pred"]
    return out


def numbered(rows):
    """With the day number as ``t`` and no factors."""
    return rows.select(*ft.KEYS, "date", "value", "is_train", (F.unix_date("date") / 100).alias("t"), F.array().cast("array<double>").alias("z"))


def day_of(c):
    return round(c * 100) - (START - dt.date(1970, 1, 1)).days


# --- hinges ---------------------------------------------------------------------------------------------------------


def plain_knots(y, steps, margin=hinges.MARGIN):
    """Forward selection by least squares over all days."""
    t, chosen = np.arange(len(y)), []
    for _ in range(steps):
        def error(c):
            x = np.column_stack([np.ones(len(y)), t, *[np.maximum(t - k, 0) for k in [*chosen, c]]])
            miss = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            return miss @ miss
        chosen.append(min((c for c in range(margin, len(y) - margin) if c not in chosen), key=error))
    return chosen


def test_one_kink_is_the_one_knot(spark):
    kink = [5 + 0.2 * i + 1.5 * max(i - 60, 0) for i in range(150)]
    flat = [7.0] * 150
    rows = numbered(frame(spark, {"kink": kink, "flat": flat, "line": [2 * i for i in range(150)]}, test=20))
    train = rows.where("is_train")
    terms = {r["series"]: r["chosen"] for r in hinges.chosen_terms(train, 0).collect()}
    assert [day_of(k["c"]) for k in terms["kink"]] == [60] and not terms["flat"] and not terms["line"]
    model = {r["series"]: r["model"] for r in hinges.backward(hinges.chosen_terms(train, 0)).collect()}
    assert [m["kind"] for m in model["flat"]] == [hinges.CONSTANT] and [m["kind"] for m in model["line"]] == [hinges.CONSTANT, hinges.LINE]
    found = predictions(hinges.fitted(rows, 0))
    assert [found["kink"][i] for i in range(150)] == pytest.approx(kink) and found["flat"] == pytest.approx(dict.fromkeys(range(150), 7.0))


def test_knots_equal_a_search_over_all_days(spark):
    rng = np.random.default_rng(2)
    given = {f"s{k}": np.cumsum(rng.normal(size=90)) * 4 + rng.normal(size=90) for k in range(6)}
    train = numbered(frame(spark, given, test=0))
    found = {r["series"]: [day_of(k["c"]) for k in r["chosen"]] for r in hinges.chosen_terms(train, 0, terms=4).collect()}
    assert found == {n: plain_knots(y, 4) for n, y in given.items()}


def test_factors_are_candidates_and_noise_is_pruned(spark):
    rng = np.random.default_rng(3)
    days = 900
    level = [int(200 <= i < 320 or 500 <= i < 560) for i in range(days)]
    y = np.array([40.0 * f for f in level]) + rng.normal(size=days)
    rows = frame(spark, {"s": y}, test=0).withColumn("t", F.unix_date("date") / 100)
    marked = spark.createDataFrame([(START + dt.timedelta(days=i), [float(f), float(i % 2)]) for i, f in enumerate(level)], "date date, z array<double>")
    train = rows.join(marked, "date").select(*ft.KEYS, "date", "value", "is_train", "t", "z")
    terms = hinges.chosen_terms(train, 2)
    first = terms.first()["chosen"][0]
    assert (first["kind"], first["j"]) == (hinges.FACTOR, 0)
    model = hinges.backward(terms).first()["model"]
    assert len(model) <= 5 and [m["beta"] for m in model if m["kind"] == hinges.FACTOR and m["j"] == 0][0] == pytest.approx(40, abs=0.5)


def test_short_series_get_a_line_or_a_level(spark):
    rows = numbered(frame(spark, {"one": [3, 9], "two": [1, 2, 9], "none": [5]}, test=1))
    found = predictions(hinges.fitted(rows, 0))
    assert found["one"] == pytest.approx({0: 3, 1: 3}) and set(found["two"]) == {0, 1, 2} and "none" not in found
    assert all(np.isfinite(v) for s in found.values() for v in s.values())


# --- autoregression -------------------------------------------------------------------------------------------------


def plain_kpss(y):
    n, e = len(y), y - np.mean(y)
    lags = int(3 * np.sqrt(n) / 13)
    long = sum((1 - k / (lags + 1)) * (2 if k else 1) * (e[k:] @ e[: n - k]) for k in range(lags + 1))
    return (np.cumsum(e) ** 2).sum() / n / long


def test_kpss_equals_its_definition(spark):
    rng = np.random.default_rng(4)
    given = {"noise": rng.normal(size=200), "walk": np.cumsum(rng.normal(size=120)), "flat": np.full(50, 3.0)}
    rows = frame(spark, given, test=0).withColumnRenamed("value", "w")
    found = {r["series"]: (r["n"], r["kpss"]) for r in arima.kpss(rows, ft.KEYS, "w", 200).collect()}
    assert found["noise"] == (200, pytest.approx(plain_kpss(given["noise"]))) and found["walk"] == (120, pytest.approx(plain_kpss(given["walk"])))
    assert found["flat"] == (50, None)


def grid_of(rows, width=0):
    return arima.daily_grid(rows.withColumn("x", F.array_repeat(F.lit(0.0), width)), width)


def test_gaps_are_laid_on_a_daily_grid(spark):
    rows = frame(spark, {"s": [0, 1, 2, 3, 40, 50, 60, 7, 8]}, test=2, skip=(3, 4, 5))
    found = [(r["y"], r["given"], r["ahead"]) for r in grid_of(rows).orderBy("date").collect()]
    assert [y for y, *_ in found] == [0, 1, 2, 16.5, 31, 45.5, 60, None, None]
    assert [g for _, g, _ in found] == [True] * 3 + [False] * 3 + [True] * 3 and [a for *_, a in found] == [False] * 7 + [True] * 2


def test_differences_follow_the_series(spark):
    rng = np.random.default_rng(5)
    n = 300
    week = np.tile([0, 3, 9, 4, 1, -8, -9], 50)[:n]
    given = {"noise": rng.normal(size=n), "walk": np.cumsum(rng.normal(size=n)), "weekly": week + 0.2 * rng.normal(size=n), "short": [1, 5, 2, 7, 1, 1, 9, 3]}
    found = {r["series"]: (r["weekly"], r["d"]) for r in arima.differences(grid_of(frame(spark, given, test=0))).collect()}
    assert found == {"noise": (0, 0), "walk": (0, 1), "weekly": (1, 0), "short": (0, 0)}
    rows = arima.design(grid_of(frame(spark, {"weekly": given["weekly"]}, test=0)), 0).orderBy("date").collect()
    assert [r["w"] for r in rows[7:]] == pytest.approx(list(given["weekly"][7:] - given["weekly"][:-7])) and rows[6]["w"] is None


def test_levinson_solves_the_normal_equations(spark):
    gamma = [5.0, 3.1, 1.2, 0.7, -0.4]
    row = spark.range(1).select(arima.levinson(F.array(*map(F.lit, gamma)), 4).alias("phi")).first()
    matrix = np.array([[gamma[abs(i - j)] for j in range(4)] for i in range(4)])
    assert row["phi"] == pytest.approx(np.linalg.solve(matrix, gamma[1:]).tolist())
    assert spark.range(1).select(arima.levinson(F.array(F.lit(0.0), F.lit(0.0)), 1).alias("phi")).first()["phi"] == [0.0]


def test_terms_of_a_known_process_are_found(spark):
    rng = np.random.default_rng(6)
    e = rng.normal(size=3000)
    ar, ma = np.zeros(3000), np.zeros(3000)
    for i in range(2, 3000):
        ar[i] = 0.5 * ar[i - 1] + 0.3 * ar[i - 2] + e[i]
        ma[i] = e[i] + 0.6 * e[i - 1]
    rows = frame(spark, {"ar": ar, "ma": ma}, test=10).withColumn("x", F.array().cast("array<double>"))
    pred, models = arima.arima(rows)
    beta = {r["series"]: r["beta"] for r in models.collect()}
    assert beta["ar"][1:3] == pytest.approx([0.5, 0.3], abs=0.08)
    found = predictions(pred)
    assert np.std([ma[i] - found["ma"][i] for i in range(100, 2990)]) < 1.05 < np.std(ma[100:2990])  # the moving average explains the rest
    assert len(found["ar"]) == 3000 and all(np.isfinite(v) for v in found["ar"].values())


def test_forecast_continues_lines_weeks_and_levels(spark):
    line, week = [3 + 2.0 * i for i in range(120)], [float([5, 9, 2, 4, 8, 1, 7][i % 7]) for i in range(120)]
    rows = frame(spark, {"line": line, "week": week}).withColumn("x", F.array().cast("array<double>"))
    found = predictions(arima.arima(rows)[0])
    assert [found["line"][i] for i in range(120)] == pytest.approx(line) and [found["week"][i] for i in range(106, 120)] == pytest.approx(week[106:])
    level = [100.0 * (i // 20 % 2) + (i * 7919 % 13) / 13 for i in range(200)]
    rows = frame(spark, {"s": level}, test=30).withColumn("x", F.array((F.datediff("date", F.lit(START)) / 20).cast("int").cast("double") % 2))
    found = predictions(arima.arima(rows, 1)[0])["s"]
    assert [found[i] for i in range(170, 200)] == pytest.approx(level[170:], abs=12)


def test_each_model_fits_alone(spark):
    wave = [50 + 10 * np.sin(i / 20) + i % 3 for i in range(120)]
    rows = ft.model_features(frame(spark, {"s": wave, "short": wave[:18]}))
    for model in [*md.SOLVED, md.ARIMA, md.ARIMA_PLAIN, md.ETS, md.HINGE, md.ARIMA_BOOSTED, md.TREND_BOOSTED, md.FOREST]:
        found = md.fit_models(rows, [model]).collect()
        assert len(found) == 138 and all(r["model_id"] == model and np.isfinite(r["pred"]) for r in found), model


# --- smoothing ------------------------------------------------------------------------------------------------------


def plain_states(values, s):
    season = s.season
    mean = sum(values[:7]) / len(values[:7])
    base, damped, error, out = values[0] if season == ets.NONE else mean, 0.0, 0.0, []
    due = [0.0] * 7 if season == ets.NONE else [v - mean if season == ets.ADDED else v / mean for v in values[:7]]
    for v in values:
        now = base * due[0] if season == ets.MULTIPLIED else base + due[0]
        miss = v - now
        scaled = miss / due[0] if season == ets.MULTIPLIED else miss
        turned = due[0] + s.gamma * (1 - s.alpha) * (miss / base if season == ets.MULTIPLIED else miss)
        damped = s.damp * (damped + s.alpha * s.beta * scaled)
        base, due, error = base + s.alpha * scaled + damped, [*due[1:], turned], error + miss * miss
        out.append(now)
    return base, damped, due, error, out


def test_folds_equal_a_loop(spark):
    rng = np.random.default_rng(8)
    values = (50 + 10 * np.sin(np.arange(150) / 9) + np.tile([1, 4, 9, 3, 0, -7, -9], 22)[:150] + rng.normal(size=150)).tolist()
    series = ets.known_values(frame(spark, {"s": values}, test=0))
    settings = [ets.Setting(0.3, 0.0, 0.0, 0.0, ets.NONE), ets.Setting(0.4, 0.2, 0.9, 0.3, ets.ADDED), ets.Setting(0.2, 0.1, 1.0, 0.2, ets.MULTIPLIED)]
    for row in ets.last_states(series, settings).collect():
        s = ets.Setting(*[row["s"][f] for f in ets.Setting._fields])
        base, damped, due, error, _ = plain_states(values, s)
        found = row["state"]
        assert (found["base"], found["damped"], found["error"]) == pytest.approx((base, damped, error)) and [found[n] for n in ets.DUE] == pytest.approx(due)
    for s in settings:
        row = ets.with_settings(series, [s]).select(ets.one_step(F.col("values"), F.col("s")).alias("out")).first()
        assert row["out"] == pytest.approx(plain_states(values, s)[4])


def test_smoothing_continues_trend_and_season(spark):
    season = [1, 4, 9, 3, 0, -7, -10]
    added = [100.0 + season[i % 7] for i in range(140)]
    times = [(50 + 0.5 * i) * (1 + season[i % 7] / 20) for i in range(280)]
    found = predictions(ets.smooth(frame(spark, {"added": added, "times": times, "one": [4.0, 9.0], "tiny": [1.0] * 20})))
    assert [found["added"][i] for i in range(140)] == pytest.approx(added)
    assert [found["times"][i] for i in range(266, 280)] == pytest.approx(times[266:], rel=0.05)
    assert "one" not in found and found["tiny"] == pytest.approx(dict.fromkeys(range(20), 1.0))


def test_multiplied_seasons_need_positive_values(spark):
    series = ets.known_values(frame(spark, {"zero": [0.0, 1, 2, 3, 4, 5, 6] * 6, "short": [1.0] * 20}, test=0))
    kinds = {}
    for r in ets.with_settings(series, ets.SETTINGS).collect():
        kinds.setdefault(r["series"], set()).add(r["s"]["season"])
    assert kinds == {"zero": {ets.NONE, ets.ADDED}, "short": {ets.NONE}}
