"""Exponential smoothing with level, damped trend and weekly season, for all series at once.

Every combination of states and weights is a row next to the series' values; one fold over the values in the JVM
gives its error and last states, and the combination with the smallest corrected AIC counts.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from wardwatch.forecast.arima import WEEK, daily_grid
from wardwatch.forecast.features import KEYS, spread
from wardwatch.session import settle

NONE, ADDED, MULTIPLIED = 0, 1, 2
SEASONAL_FROM = 3 * WEEK  # days; shorter series have no season


class Setting(NamedTuple):
    alpha: float  # of the level
    beta: float  # of the trend, as a part of alpha; 0 with damp 0: no trend
    damp: float  # of the trend; 1: not damped
    gamma: float  # of the season, as a part of 1 - alpha
    season: int

    def size(self) -> int:
        """Estimated numbers: weights, first states, variance."""
        return 3 + (2 + (self.damp < 1) if self.damp else 0) + (WEEK if self.season else 0)


ALPHAS, TRENDS = (0.1, 0.3, 0.5, 0.7, 0.9), ((0.0, 0.0), (0.1, 0.95), (0.1, 1.0))
SEASONS = ((0.0, NONE), (0.15, ADDED), (0.15, MULTIPLIED))
PART = 64
DUE = [f"s{i}" for i in range(WEEK)]  # seasons, the one that is due first
SETTINGS = [Setting(a, b, d, g, s) for a, (b, d), (g, s) in product(ALPHAS, TRENDS, SEASONS)]


def known_values(rows: DataFrame) -> DataFrame:
    """``days, last, values`` of each series: the training values on a daily grid in the order of the date."""
    plain = rows.select(*KEYS, "date", "value", "is_train", F.array().cast("array<double>").alias("x"))
    grid = daily_grid(plain).where("NOT ahead")
    points = F.array_sort(F.collect_list(F.struct("date", "y")))
    return grid.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("days"), F.max("date").alias("last"), F.transform(points, lambda p: p["y"]).alias("values")
    )


def first_states(values: Column, season: Column) -> dict[str, Column]:
    """``base`` (the level and the damped trend), the ``damped`` trend and the seasons of the first week; without a season the first value."""
    week = F.slice(values, 1, WEEK)
    mean = F.aggregate(week, F.lit(0.0), lambda s, v: s + v) / F.size(week)

    def due(i: int) -> Column:
        value = F.get(values, F.lit(i))
        return F.coalesce(F.when(season == ADDED, value - mean).when(season == MULTIPLIED, value / mean), F.lit(0.0))

    base = F.when(season == NONE, F.get(values, F.lit(0))).otherwise(mean)
    return {"base": base, "damped": F.lit(0.0)} | {name: due(i) for i, name in enumerate(DUE)}


def expected(base: Column, season: Column, kind: Column) -> Column:
    return F.when(kind == MULTIPLIED, base * season).otherwise(base + season)


def step(state: Column, value: Column, s: Column, more) -> Column:
    """The states after a value, with the columns that ``more(miss)`` adds."""
    base, due, ratio = state["base"], state["s0"], s["season"] == MULTIPLIED
    miss = value - expected(base, due, s["season"])

    def after(m: Column) -> Column:
        damped = s["damp"] * (state["damped"] + s["trend"] * F.when(ratio, m / due).otherwise(m))
        later = due + s["turn"] * F.when(ratio, m / base).otherwise(m)
        parts = {"base": base + s["alpha"] * F.when(ratio, m / due).otherwise(m) + damped, "damped": damped}
        return struct_of(parts | {name: state[f"s{i + 1}"] for i, name in enumerate(DUE[:-1])} | {DUE[-1]: later} | more(m))

    return F.get(F.transform(F.array(miss), after), F.lit(0))  # the miss is computed once


def struct_of(parts: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def folded(values: Column, s: Column) -> Column:
    """The states after the last value and the sum ``error`` of squared misses."""
    start = struct_of(first_states(values, s["season"]) | {"error": F.lit(0.0)})
    return F.aggregate(values, start, lambda state, v: step(state, v, s, lambda m: {"error": state["error"] + m * m}))


def one_step(values: Column, s: Column) -> Column:
    """What is expected of each day from the days before it. Results gather by parts, as an array is copied when it grows."""
    none = F.array().cast("array<double>")
    states = first_states(values, s["season"])
    last = F.floor((F.size(values) - 1) / PART).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * PART + 1, F.lit(PART)))

    def inner(state: Column, v: Column) -> Column:
        return step(state, v, s, lambda m: {"out": F.concat(state["out"], F.array(v - m))})

    def outer(state: Column, part: Column) -> Column:
        fresh = struct_of({name: state[name] for name in states} | {"out": none})
        bound = F.transform(F.array(F.aggregate(part, fresh, inner)), lambda after: struct_of(
            {name: after[name] for name in states} | {"out": F.concat(state["out"], after["out"])}
        ))
        return F.get(bound, F.lit(0))

    return F.aggregate(parts, struct_of(states | {"out": none}), outer)["out"]


def with_settings(series: DataFrame, settings: list[Setting]) -> DataFrame:
    """Each series next to each setting ``s`` that it allows: seasons need three weeks, multiplied ones positive values."""
    def row(s: Setting) -> Column:
        weights = s._asdict() | {"size": s.size(), "trend": s.alpha * s.beta, "turn": s.gamma * (1 - s.alpha)}
        return F.struct(*[F.lit(v).alias(n) for n, v in weights.items()])

    rows = F.array(*map(row, settings))  # literals: no join
    positive = F.forall("values", lambda v: v > 0)
    allowed = F.filter(rows, lambda s: (s["season"] == NONE) | ((F.col("days") >= SEASONAL_FROM) & ((s["season"] == ADDED) | positive)))
    return series.select("*", F.explode(allowed).alias("s"))


def last_states(series: DataFrame, settings: list[Setting] = SETTINGS) -> DataFrame:
    """``s, state, aicc`` of each series and setting."""
    rows = with_settings(series, settings).withColumn("state", folded(F.col("values"), F.col("s")))
    n, k = F.col("days").cast("double"), F.col("s.size").cast("double")
    error = F.greatest(F.col("state.error") / n, F.lit(1e-12))
    return rows.withColumn("aicc", n * F.ln(error) + 2 * k + F.when(n > k + 1, 2 * k * (k + 1) / (n - k - 1)).otherwise(F.lit(float("inf"))))


def ahead(state: Column, s: Column, steps: Column) -> Column:
    """The forecast ``steps`` days after the last value."""
    trend = F.when(s["damp"] < 1, s["damp"] * (1 - F.pow(s["damp"], steps - 1)) / (1 - s["damp"])).otherwise(steps - 1)
    season = F.get(F.array(*[state[name] for name in DUE]), F.pmod(steps - 1, F.lit(WEEK)).cast("int"))
    return expected(state["base"] + state["damped"] * trend, season, s["season"])


def smooth(rows: DataFrame, settings: list[Setting] = SETTINGS) -> DataFrame:
    """``KEYS, date, pred`` for all rows: one-step values on training rows, the forecast after the last of them.

    Equal scores go to the setting with fewer numbers, then to the first of them. Series without a training row have none.
    """
    series = settle(spread(known_values(rows)))
    order = F.struct("aicc", "s.size", "s.season", "s.damp", "s.beta", "s.alpha", "s.gamma")
    best = last_states(series, settings).groupBy(*KEYS).agg(F.min_by(F.struct("s", "state"), order).alias("best"))
    best = settle(series.join(best, KEYS).select(*KEYS, "last", "days", "best.s", "best.state", "values"))
    dates = F.transform(F.sequence(F.lit(0), F.col("days").cast("int") - 1), lambda i: F.date_add("last", i + 1 - F.col("days").cast("int")))
    fitted = best.select(*KEYS, F.explode(F.arrays_zip(dates.alias("date"), one_step(F.col("values"), F.col("s")).alias("pred"))).alias("p"))
    fitted = rows.where("is_train").select(*KEYS, "date").join(fitted.select(*KEYS, "p.date", "p.pred"), [*KEYS, "date"])
    later = rows.select(*KEYS, "date").join(best.drop("values"), KEYS).where("date > last")
    later = later.select(*KEYS, "date", ahead(F.col("state"), F.col("s"), F.datediff("date", "last").cast("double")).alias("pred"))
    return fitted.unionByName(later)
