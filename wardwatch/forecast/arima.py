"""Autoregressive moving averages with regressors, for all series at once, by grouped regressions.

A series is laid on a daily grid. It is differenced over a week where its weekly pattern is strong, and then as
often as the KPSS statistic asks for. A long autoregression (from autocovariances) gives the residuals that stand for the
moving-average terms; the values are then regressed on lags, lagged residuals and regressors, with the orders that have the
smallest corrected AIC. Sums come from windows and aggregates over all series; a task sees one row of products for a series.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwatch.forecast.features import KEYS, spread
from wardwatch.session import settle

WEEK = 7
STRONG = 0.64  # a weekly pattern that explains more than this is differenced away
KPSS_CRITICAL = 0.463  # fixed value: 5 % point of the KPSS statistic around a level
MOST_DIFFERENCES = 2
LONG = 14  # order of the long autoregression
LAGS, RESIDUALS = 5, 3  # most autoregressive and moving-average terms
SHORTEST = 3 * LONG  # days; a shorter series repeats its last value
REACH = WEEK + MOST_DIFFERENCES  # days that a difference looks back


def by_day() -> Window:
    return Window.partitionBy(*KEYS).orderBy("date")


def daily_grid(rows: DataFrame, width: int = 0) -> DataFrame:
    """``KEYS, date, y, x, ahead`` for each day from the first training row to the last row.

    Missing days lie on the line between their neighbours and have the regressors ``x`` (``width`` numbers) of the day before;
    ``y`` is null after the last training row. ``given`` marks the days that ``rows`` has.
    """
    known = F.col("is_train") & F.col("value").isNotNull()
    train_date = F.when(known, F.col("date"))
    spans = rows.groupBy(*KEYS).agg(F.min(train_date).alias("first"), F.max(train_date).alias("last"), F.max("date").alias("end"))
    days = spans.where(F.col("first").isNotNull()).select(*KEYS, "last", F.explode(F.sequence("first", "end")).alias("date"))
    own = rows.select(*KEYS, "date", F.when(known, F.col("value")).alias("v"), "x", F.lit(True).alias("given"))
    grid = spread(days).join(own, [*KEYS, "date"], "left")
    past = by_day().rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*KEYS).orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)  # linear, unlike a frame that shrinks
    point = F.when(F.col("v").isNotNull(), F.struct(F.unix_date("date").alias("d"), F.col("v").alias("v")))
    grid = grid.withColumns({"a": F.last(point, ignorenulls=True).over(past), "b": F.last(point, ignorenulls=True).over(later)})
    a, b = F.col("a"), F.col("b")
    line = a["v"] + F.coalesce(F.try_divide(b["v"] - a["v"], (b["d"] - a["d"]).cast("double")), F.lit(0.0)) * (F.unix_date("date") - a["d"])
    return grid.select(
        *KEYS, "date", F.when(F.col("date") <= F.col("last"), line).alias("y"),
        F.coalesce(F.last("x", ignorenulls=True).over(past), F.array_repeat(F.lit(0.0), width)).alias("x"),
        F.coalesce("given", F.lit(False)).alias("given"), (F.col("date") > F.col("last")).alias("ahead"),
    )


# --- how often to difference ----------------------------------------------------------------------------------------


def weekly_strength(grid: DataFrame) -> DataFrame:
    """``days, strength`` of each series: the part of the variance around a centred weekly mean that weekdays explain; 0 below three weeks."""
    near = by_day().rowsBetween(-(WEEK // 2), WEEK // 2)
    known = grid.where("NOT ahead")
    off = F.when(F.count("y").over(near) == WEEK, F.col("y") - F.avg("y").over(near))
    known = known.withColumns({"off": off, "weekday": F.pmod(F.unix_date("date"), F.lit(WEEK))})
    each = known.groupBy(*KEYS, "weekday").agg(
        F.count(F.lit(1)).alias("rows"), F.count("off").alias("n"), F.avg("off").alias("mean"), F.sum(F.col("off") * F.col("off")).alias("square")
    )
    n, mean = F.sum("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
    total = F.sum("square") - n * mean * mean
    explained = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    share = F.try_divide(explained, F.when(total > 1e-9 * F.sum("square"), total))
    sums = each.groupBy(*KEYS).agg(F.sum("rows").alias("days"), share.alias("share"))
    return sums.select(*KEYS, "days", F.when(F.col("days") >= 3 * WEEK, F.coalesce("share", F.lit(0.0))).otherwise(F.lit(0.0)).alias("strength"))


def coefficients(weekly: int, times: int) -> list[float]:
    """Of the value and those before it in the given differences."""
    out = np.array([1.0])
    for step in [WEEK] * weekly + [1] * times:
        out = np.convolve(out, [1.0] + [0.0] * (step - 1) + [-1.0])
    return out.tolist()


def differenced(column: Column, weekly: int, times: int) -> Column:
    """Null where the difference looks back past the first day."""
    parts = [c * F.lag(column, k).over(by_day()) if k else column for k, c in enumerate(coefficients(weekly, times)) if c]
    return sum(parts[1:], parts[0])


def kpss(rows: DataFrame, keys: list[str], column: str, most: int) -> DataFrame:
    """``n, lags, kpss`` around a level, for each key, of the values of a column in the order of ``date``; no key has over ``most`` rows.

    The long-run variance has Bartlett weights over ``3 sqrt(n) / 13`` lags, rounded down. Null for a series that does not move.
    """
    window, running = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where(F.col(column).isNotNull())
    steps = int(3 * most**0.5 / 13)
    off = rows.select(*keys, "date", F.col(column).alias("v"), F.avg(column).over(window).alias("mean"), F.count(F.lit(1)).over(window).alias("n"))
    off = off.select(*keys, "date", "n", (F.col("v") - F.col("mean")).alias("e"), F.floor(3 * F.sqrt("n") / 13).cast("int").alias("lags"), (F.abs("v")).alias("size"))
    ordered = Window.partitionBy(*keys).orderBy("date")
    pull = F.lit(0.0)
    for k in range(1, steps + 1):
        weight = F.greatest(F.lit(0.0), 1 - F.lit(float(k)) / (F.col("lags") + 1))
        pull = pull + 2 * weight * F.coalesce(F.lag("e", k).over(ordered), F.lit(0.0))
    parts = off.select(
        *keys, "n", "lags", F.pow(F.sum("e").over(running), F.lit(2)).alias("s2"), (F.col("e") * (F.col("e") + pull)).alias("long"),
        F.col("size"),
    )
    sums = parts.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("lags").alias("lags"), F.sum("s2").alias("s2"), F.sum("long").alias("long"), F.max("size").alias("size")
    )
    moved = F.when(F.col("long") > 1e-18 * F.col("n") * F.col("size") * F.col("size"), F.col("n") * F.col("long"))
    return sums.select(*keys, "n", "lags", F.try_divide(F.col("s2"), moved).alias("kpss"))


def difference_rows(grid: DataFrame, strength: DataFrame) -> DataFrame:
    """``KEYS, weekly, d, date, w``: the known values, differenced weekly where that is due, and d times more."""
    values = grid.where("NOT ahead").join(strength.select(*KEYS, (F.col("strength") > STRONG).cast("int").alias("weekly")), KEYS)
    chosen = [
        F.struct(F.lit(d).alias("d"), F.when(F.col("weekly") == 1, differenced(F.col("y"), 1, d)).otherwise(differenced(F.col("y"), 0, d)).alias("w"))
        for d in range(MOST_DIFFERENCES + 1)
    ]
    return values.select(*KEYS, "weekly", "date", F.array(*chosen).alias("each")).select(*KEYS, "weekly", "date", F.inline("each"))


def differences(grid: DataFrame) -> DataFrame:
    """``days, weekly, d`` of each series: the fewest differences whose KPSS statistic is below the critical value."""
    strength = settle(weekly_strength(grid))
    most = strength.agg(F.max("days")).first()[0] or 0  # one number
    tests = kpss(difference_rows(grid, strength), [*KEYS, "d"], "w", most)
    enough = F.when(F.coalesce("kpss", F.lit(0.0)) <= KPSS_CRITICAL, F.col("d"))
    fewest = tests.groupBy(*KEYS).agg(F.coalesce(F.min(enough), F.lit(MOST_DIFFERENCES)).alias("d"))
    return strength.join(fewest, KEYS).select(*KEYS, "days", (F.col("strength") > STRONG).cast("int").alias("weekly"), "d")


# --- the long autoregression ----------------------------------------------------------------------------------------


def autocovariances(values: DataFrame, order: int = LONG) -> DataFrame:
    """``mean, gamma`` (an array from lag 0 on) of the non-null ``w`` of each series; they follow each other."""
    window = Window.partitionBy(*KEYS)
    off = values.where(F.col("w").isNotNull()).select(*KEYS, "date", F.avg("w").over(window).alias("mean"), (F.col("w") - F.avg("w").over(window)).alias("e"))
    lagged = off.select(*KEYS, "mean", "e", *[F.lag("e", k).over(by_day()).alias(f"e{k}") for k in range(1, order + 1)])
    products = [F.sum(F.col("e") * F.col("e"))] + [F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)) for k in range(1, order + 1)]
    return lagged.groupBy(*KEYS).agg(F.first("mean").alias("mean"), F.array(*[p / F.count(F.lit(1)) for p in products]).alias("gamma"))


def levinson(gamma: Column, order: int = LONG) -> Column:
    """Coefficients of the autoregression with these autocovariances, by the Levinson recursion; zeros once nothing is left to explain."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.element_at(gamma, 1).alias("left"))

    def step(state: Column, k: Column) -> Column:
        back = F.reverse(F.slice(gamma, 2, k - 1))  # lags k - 1 down to 1
        rest = F.element_at(gamma, k + 1) - F.when(k > 1, dot(state["phi"], back)).otherwise(F.lit(0.0))
        kappa = F.when(state["left"] > 1e-12 * F.element_at(gamma, 1), rest / state["left"]).otherwise(F.lit(0.0))
        bound = F.transform(F.array(kappa), lambda c: F.struct(
            F.concat(F.zip_with(state["phi"], F.reverse(state["phi"]), lambda p, q: p - c * q), F.array(c)).alias("phi"),
            (state["left"] * (1 - c * c)).alias("left"),
        ))
        return F.element_at(bound, 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, step)["phi"]


# --- regression on lags, lagged residuals and regressors ------------------------------------------------------------


def grouped_products(rows: DataFrame, column: str, width: int) -> DataFrame:
    """``n`` and ``gram`` of each series: the products of all pairs of a row's array of ``width`` numbers, as a flat array."""
    each = rows.select(*KEYS, F.col(column).alias("f"), F.posexplode(column).alias("i", "v"))
    sums = each.groupBy(*KEYS, "i").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v") * F.col("f")[k]) for k in range(width)]).alias("row"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda s: s["row"])
    return sums.groupBy(*KEYS).agg(F.max("n").alias("n"), F.flatten(lines).alias("gram"))


def chosen_order(gram: np.ndarray, n: int, constant: bool) -> np.ndarray:
    """Coefficients (zeros where unused) of the regression with the least corrected AIC.

    ``gram`` has the products of a constant, ``LAGS`` lags, ``RESIDUALS`` lagged residuals, regressors, and, last, the values.
    Orders whose autoregression is not stationary, or whose moving average can't be inverted, do not count.
    """
    width, best = len(gram) - 1, (np.inf, 0, np.zeros(len(gram) - 1))
    for p, q in product(range(LAGS + 1), range(RESIDUALS + 1)):
        used = [0] * constant + [*range(1, p + 1), *range(1 + LAGS, 1 + LAGS + q), *range(1 + LAGS + RESIDUALS, width)]
        some = gram[np.ix_(used, used)]
        beta = np.zeros(width)
        beta[used] = np.linalg.lstsq(some, gram[used, width], rcond=1e-10)[0] if used else []
        if not (stable(beta[1 : 1 + p]) and stable(-beta[1 + LAGS : 1 + LAGS + q])):
            continue
        error = max(gram[width, width] - 2 * beta @ gram[:width, width] + beta @ gram[:width, :width] @ beta, 1e-12 * gram[width, width] + 1e-12)
        k = len(used) + 1
        score = n * np.log(error / n) + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else np.inf)
        best = min(best, (score, p + q, beta), key=lambda b: b[:2])
    return best[2]


def stable(weights: np.ndarray) -> bool:
    return bool(not len(weights) or np.abs(np.roots(np.concatenate([[1.0], -weights]))).max(initial=0.0) < 0.999)


def path(beta: np.ndarray, back: list[float], w: list[float], e: list[float], y: list[float], x: list[list[float]]) -> list[float]:
    """Values ahead. ``w, e, y``: what is known, latest first; ``back``: the differences' coefficients; ``x``: regressors ahead."""
    out = []
    for row in x:
        step = beta[0] + beta[1 : 1 + LAGS] @ w[:LAGS] + beta[1 + LAGS : 1 + LAGS + RESIDUALS] @ e[:RESIDUALS] + beta[1 + LAGS + RESIDUALS :] @ row
        value = step - sum(c * v for c, v in zip(back[1:], y))
        w, e, y = [step, *w], [0.0, *e], [value, *y]
        out.append(float(value))
    return out


def design(grid: DataFrame, width: int, order: int = LONG) -> DataFrame:
    """The grid with ``days, weekly, d``, the differenced values ``w``, regressors ``dx``, residuals ``e`` of the long autoregression and the array ``f``."""
    plan = settle(differences(grid))
    rows = grid.join(plan, KEYS)

    def by_plan(column: Column) -> Column:
        out = F.lit(None).cast("double")
        for weekly, d in product((0, 1), range(MOST_DIFFERENCES + 1)):
            out = F.when((F.col("weekly") == weekly) & (F.col("d") == d), differenced(column, weekly, d)).otherwise(out)
        return out

    rows = settle(rows.select("*", by_plan(F.col("y")).alias("w"), F.array(*[by_plan(F.col("x")[j]) for j in range(width)]).cast("array<double>").alias("dx")))
    long = autocovariances(rows.where("NOT ahead"), order).select(*KEYS, "mean", levinson(F.col("gamma"), order).alias("phi"))
    rows = rows.join(long, KEYS)
    expected = F.col("mean")
    for k in range(1, order + 1):
        expected = expected + F.col("phi")[k - 1] * (F.lag("w", k).over(by_day()) - F.col("mean"))
    rows = rows.withColumn("e", F.col("w") - expected)
    lags = [F.lag("w", k).over(by_day()) for k in range(1, LAGS + 1)] + [F.lag("e", k).over(by_day()) for k in range(1, RESIDUALS + 1)]
    numbers = F.concat(F.array(F.lit(1.0), *lags), F.col("dx"), F.array("w"))
    return rows.withColumn("f", F.when(F.forall(numbers, lambda v: v.isNotNull()), numbers)).drop("mean", "phi")


def arima(rows: DataFrame, width: int = 0) -> tuple[DataFrame, DataFrame]:
    """The fit: ``KEYS, date, pred`` of all rows, and for each series ``days, weekly, d, beta``.

    ``rows`` have ``KEYS, date, value, is_train`` and ``x``, an array of ``width`` regressors. Days before the first regression row
    are fitted by their own value. ``beta`` is a constant, the lags', residuals' and regressors' coefficients; it is null for series
    of less than ``SHORTEST`` days, which repeat the day before.
    """
    grid = settle(daily_grid(rows, width))
    full = settle(design(grid, width))
    size = 1 + LAGS + RESIDUALS + width
    products = grouped_products(full.where(F.col("f").isNotNull() & ~F.col("ahead")), "f", size + 1)
    latest = F.reverse(F.array_sort(F.collect_list(F.when(~F.col("ahead"), F.struct("date", "y", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("e", F.lit(0.0)).alias("e"))))))
    coming = F.array_sort(F.collect_list(F.when(F.col("ahead"), F.struct("date", "dx"))))
    near = Window.partitionBy(*KEYS)
    last_day = F.max(F.when(~F.col("ahead"), F.col("date"))).over(near)
    tail = full.withColumn("last", last_day).where(F.col("date") > F.date_sub("last", REACH + 1))
    ends = tail.groupBy(*KEYS).agg(
        F.first("days").alias("days"), F.first("weekly").alias("weekly"), F.first("d").alias("d"), latest.alias("latest"), coming.alias("coming")
    )
    flat = ends.join(products, KEYS, "left").select(
        *KEYS, "days", "weekly", "d", "n", "gram", "latest.y", "latest.w", "latest.e", F.col("coming.date").alias("dates"), "coming.dx",
    )

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                if row.gram is None or row.days < SHORTEST:
                    made.append((None, [float(row.y[0])] * len(row.dates)))
                    continue
                gram = np.array(row.gram).reshape(size + 1, size + 1)
                beta = chosen_order(gram, int(row.n), row.weekly + row.d <= 1)
                x = [np.array(r, dtype=float) if len(r) else np.zeros(0) for r in row.dx]
                made.append((beta, path(beta, coefficients(row.weekly, row.d), list(row.w), list(row.e), list(row.y), x)))
            yield batch[[*KEYS, "days", "weekly", "d", "dates"]].assign(beta=[b for b, _ in made], preds=[p for _, p in made])

    schema = "series string, variable string, days long, weekly int, d int, dates array<date>, beta array<double>, preds array<double>"
    models = settle(flat.mapInPandas(over, schema))
    dot = F.aggregate(F.zip_with("beta", F.slice("f", 1, size), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    before = F.coalesce(F.lag("y").over(by_day()), F.col("y"))
    fitted = full.where("NOT ahead").withColumn("before", before).join(models.select(*KEYS, "beta"), KEYS).where("given")
    fitted = fitted.select(*KEYS, "date", F.when(F.col("beta").isNull(), F.col("before")).otherwise(F.col("y") + F.coalesce(dot - F.col("w"), F.lit(0.0))).alias("pred"))
    steps = models.select(*KEYS, F.explode(F.arrays_zip("dates", "preds")).alias("s")).select(*KEYS, F.col("s.dates").alias("date"), F.col("s.preds").alias("pred"))
    wanted = full.where("given AND ahead").select(*KEYS, "date")
    return fitted.unionByName(steps.join(wanted, [*KEYS, "date"])), models.select(*KEYS, "days", "weekly", "d", "beta")
