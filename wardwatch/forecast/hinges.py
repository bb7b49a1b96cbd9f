"""Hinge regression with an adaptive search for knots, for all series at once.

Terms are hinges ``max(t - c, 0)`` at training dates c and 0/1 factors (months, levels), besides a constant and a line.
Running sums from the last date backwards give the products of every candidate hinge with the values, the factors and
any other hinge, in one window pass. The forward pass then is a pivoted Cholesky decomposition over the candidates:
each keeps its products with the terms chosen so far (``w``), with what these leave of the values (``u``), and
the square of what they leave of itself (``v``); the one with the largest drop in squared error, u² / v, is next. The
backward pass removes terms by generalised cross validation on the triangular factor, a dozen numbers a side for each series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwatch.forecast.features import KEYS, spread
from wardwatch.operators.reshape import rbind

TERMS = 8  # that the forward pass chooses at most
MARGIN = 7  # training rows before and after a knot at least
PENALTY = 2.0  # for each term in the cross validation
TINY = 1e-8  # part of a candidate that must be left for it to count as a new direction
CONSTANT, LINE, HINGE, FACTOR = -2, -1, 0, 1
CANDIDATE = ["kind", "j", "c", "s0", "s1", "s2", "own", "one", "line", "y", "d"]


def totals(train: DataFrame) -> DataFrame:
    """Sums of each series: ``n, mean`` and root of squares ``side`` of t, ``z1, z2`` (products of the values with the two unit base terms), ``yy``."""
    t, y = F.col("t"), F.col("value")
    sums = train.groupBy(*KEYS).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(t).alias("mean"), F.coalesce(F.var_pop(t), F.lit(0.0)).alias("var"),
        F.sum(y).alias("sy"), F.coalesce(F.covar_pop(t, y), F.lit(0.0)).alias("cov"), F.sum(y * y).alias("yy"),
        (F.count(F.lit(1)) * F.var_pop(y)).alias("spread"),
    )
    side = F.sqrt(F.col("n") * F.col("var"))
    return sums.select(
        *KEYS, "n", "mean", side.alias("side"), (F.col("sy") / F.sqrt("n")).alias("z1"),
        F.coalesce(F.try_divide(F.col("n") * F.col("cov"), side), F.lit(0.0)).alias("z2"), "yy", "spread",
    )


def hinge_candidates(train: DataFrame, width: int, margin: int) -> DataFrame:
    """A row for each training date but the outermost ones, with the products of its hinge."""
    later = Window.partitionBy(*KEYS).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*KEYS)
    t, y = F.col("t"), F.col("value")
    sums = {"s0": F.lit(1.0), "s1": t, "s2": t * t, "sy": y, "sty": t * y}
    sums |= {f"z{j}": F.col("z")[j] for j in range(width)} | {f"tz{j}": t * F.col("z")[j] for j in range(width)}
    rows = train.select(*KEYS, "t", F.count(F.lit(1)).over(every).alias("n"), *[F.sum(x).over(later).alias(k) for k, x in sums.items()])
    inner = F.array(*[F.col(f"tz{j}") - t * F.col(f"z{j}") for j in range(width)]).cast("array<double>")
    return rows.where((F.col("s0") > margin) & (F.col("n") - F.col("s0") >= margin)).select(
        *KEYS, F.lit(HINGE).alias("kind"), F.lit(0).alias("j"), t.alias("c"), "s0", "s1", "s2",
        (F.col("s2") - 2 * t * F.col("s1") + t * t * F.col("s0")).alias("own"), (F.col("s1") - t * F.col("s0")).alias("one"),
        (F.col("s2") - t * F.col("s1")).alias("line"), (F.col("sty") - t * F.col("sy")).alias("y"), inner.alias("d"),
    )


def factor_candidates(train: DataFrame, width: int) -> DataFrame:
    """A row for each factor that occurs in a series."""
    each = train.select(*KEYS, "t", "value", "z", F.posexplode("z").alias("j", "x")).where("x <> 0")
    x = F.col("x")
    sums = each.groupBy(*KEYS, "j").agg(
        F.sum(x).alias("one"), F.sum(x * F.col("t")).alias("line"), F.sum(x * F.col("value")).alias("y"),
        F.array(*[F.sum(x * F.col("z")[k]) for k in range(width)]).cast("array<double>").alias("d"),
    )
    none = [F.lit(0.0).alias(c) for c in ("c", "s0", "s1", "s2")]
    return sums.select(*KEYS, F.lit(FACTOR).alias("kind"), "j", *none, F.col("d")[F.col("j")].alias("own"), "one", "line", "y", "d")


def product(k: Column) -> Column:
    """Of each candidate with the chosen one."""
    c = F.col("c")

    def both(s: dict[str, Column]) -> Column:
        return s["s2"] - (c + k["c"]) * s["s1"] + c * k["c"] * s["s0"]

    mine, other = ({n: at[n] for n in ("s0", "s1", "s2")} for at in ({n: F.col(n) for n in ("s0", "s1", "s2")}, k))
    hinges = F.when(c >= k["c"], both(mine)).otherwise(both(other))
    return F.when(k["kind"] == FACTOR, F.col("d")[k["j"]]).when(F.col("kind") == FACTOR, k["d"][F.col("j")]).otherwise(hinges)


def chosen_terms(train: DataFrame, width: int, terms: int = TERMS, margin: int = MARGIN) -> DataFrame:
    """A row for each series: its totals and the array ``chosen`` in the order of the choice.

    An element has ``kind, j, c, w, u, v``; u² / v is what it lowered the error by. ``train`` has ``KEYS, t, value`` and the factors ``z``, ``width`` numbers. Of equal gains
    a hinge comes before a factor, and the earlier date or factor first. Nothing is chosen that lowers the error by
    less than rounding; all steps share one shuffle and sort.
    """
    sums = totals(train)
    candidates = hinge_candidates(train, width, margin)
    if width:
        candidates = rbind(candidates, factor_candidates(train, width))
    base = F.array(F.col("one") / F.sqrt("n"), F.coalesce(F.try_divide(F.col("line") - F.col("mean") * F.col("one"), F.col("side")), F.lit(0.0)))
    state = spread(candidates.join(sums, KEYS)).withColumn("w", base).select(
        *KEYS, *CANDIDATE, (1e-10 * F.col("spread") + 1e-18 * F.col("yy")).alias("rounding"), "w", (F.col("y") - F.col("w")[0] * F.col("z1") - F.col("w")[1] * F.col("z2")).alias("u"),
        (F.col("own") - F.col("w")[0] * F.col("w")[0] - F.col("w")[1] * F.col("w")[1]).alias("v"),
    )
    state = state.withColumn("step", F.lit(None).cast("int"))
    series = Window.partitionBy(*KEYS)
    for step in range(terms):
        gain = F.when(F.col("step").isNull() & (F.col("v") > TINY * F.col("own")), F.col("u") * F.col("u") / F.col("v"))
        state = state.withColumn("gain", F.when(gain > F.col("rounding"), gain))
        row = F.when(F.col("gain").isNotNull(), F.struct("kind", "j", "c", "s0", "s1", "s2", "d", "w", "u", "v"))
        order = F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("kind"), -F.col("c"), -F.col("j")))
        state = state.withColumn("k", F.max_by(row, order).over(series))
        k = F.col("k")
        known = F.aggregate(F.zip_with("w", k["w"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        state = state.withColumn("new", (product(k) - known) / F.sqrt(k["v"]))
        taken = (F.col("kind") == k["kind"]) & (F.col("j") == k["j"]) & (F.col("c") == k["c"])
        done = k.isNull() | F.col("step").isNotNull() | taken  # what is chosen stays as it was then
        state = state.withColumns({
            "step": F.when(taken, F.lit(step)).otherwise(F.col("step")),
            "w": F.when(done, F.col("w")).otherwise(F.concat("w", F.array("new"))),
            "u": F.when(done, F.col("u")).otherwise(F.col("u") - F.col("new") * k["u"] / F.sqrt(k["v"])),
            "v": F.when(done, F.col("v")).otherwise(F.col("v") - F.col("new") * F.col("new")),
        }).drop("new", "k", "gain")
    found = state.where("step IS NOT NULL").select(*KEYS, F.struct("step", "kind", "j", "c", "w", "u", "v").alias("term"))
    return sums.join(found.groupBy(*KEYS).agg(F.array_sort(F.collect_list("term")).alias("chosen")), KEYS, "left")


def pruned(r: np.ndarray, z: np.ndarray, rest: float, n: float, penalty: float) -> tuple[list[int], np.ndarray]:
    """The terms (columns of ``r``; the first one always) with the least generalised cross validation, and their coefficients.

    ``z`` are the values in the coordinates of ``r``, ``rest`` the square of what lies outside of them. One term at a
    time is removed, the one that raises the error least.
    """

    def solved(columns: list[int]) -> tuple[float, np.ndarray]:
        beta = np.linalg.lstsq(r[:, columns], z, rcond=None)[0]
        miss = z - r[:, columns] @ beta
        return rest + miss @ miss, beta

    kept, best = list(range(r.shape[1])), (np.inf, [], np.empty(0))
    while True:
        error, beta = solved(kept)
        room = 1 - (len(kept) + penalty * (len(kept) - 1) / 2) / n
        score = error / n / room**2 if room > 0 else np.inf
        if score <= best[0]:
            best = score, kept, beta
        if len(kept) == 1:
            return best[1], best[2]
        kept = min(([c for c in kept if c != j] for j in kept[1:]), key=lambda columns: solved(columns)[0])


def backward(terms: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """``model``: an array of ``beta, kind, j, c`` for each series, after the backward pass."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            models = []
            for row in batch.itertuples(index=False):
                chosen = [] if row.w is None else list(zip(row.w, row.v, row.u))
                r = np.zeros((len(chosen) + 2, len(chosen) + 2))
                r[0, :2], r[1, 1] = (np.sqrt(row.n), row.mean * np.sqrt(row.n)), row.side
                z = np.array([row.z1, row.z2] + [u / np.sqrt(v) for _, v, u in chosen])
                for i, (w, v, _) in enumerate(chosen, 2):
                    r[:i, i], r[i, i] = w, np.sqrt(v)
                kept, beta = pruned(r, z, max(row.yy - z @ z, 0.0), row.n, penalty)
                models.append([{"term": t, "beta": b} for t, b in zip(kept, beta.tolist())])
            yield batch[KEYS].assign(model=models)

    parts = [F.col(f"chosen.{name}").alias(name) for name in ("w", "u", "v")]
    flat = terms.select(*KEYS, "n", "mean", "side", "z1", "z2", "yy", *parts)
    found = flat.mapInPandas(over, "series string, variable string, model array<struct<term: int, beta: double>>")
    base = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(0).alias("j"), F.lit(0.0).alias("c")) for k in (CONSTANT, LINE)])
    more = F.transform(F.coalesce("chosen", F.array().cast(terms.schema["chosen"].dataType)), lambda k: F.struct(k["kind"].alias("kind"), k["j"].alias("j"), k["c"].alias("c")))
    every = terms.select(*KEYS, F.concat(base, more).alias("every"))
    named = F.transform("model", lambda m: F.struct(m["beta"].alias("beta"), *[F.get("every", m["term"])[c].alias(c) for c in ("kind", "j", "c")]))
    return found.join(every, KEYS).select(*KEYS, named.alias("model"))


def predicted(t: Column, z: Column, model: Column) -> Column:
    def term(m: Column) -> Column:
        return (
            F.when(m["kind"] == CONSTANT, 1.0).when(m["kind"] == LINE, t)
            .when(m["kind"] == HINGE, F.greatest(t - m["c"], F.lit(0.0))).otherwise(F.get(z, m["j"]))
        )

    return F.aggregate(model, F.lit(0.0), lambda total, m: total + m["beta"] * term(m))


def hinge_rows(rows: DataFrame) -> DataFrame:
    """``t`` (the normalised date) and the factors ``z`` (months, levels) of rows with ``x_linear``."""
    x = F.col("x_linear")
    return rows.select(*KEYS, "date", "value", "is_train", x[1].alias("t"), F.slice(x, 3, F.size(x)).alias("z"))


def fitted(rows: DataFrame, width: int, terms: int = TERMS, margin: int = MARGIN, penalty: float = PENALTY) -> DataFrame:
    """``KEYS, date, pred`` for all rows of ``rows(KEYS, date, value, is_train, t, z)``; series without a training row have none."""
    train = rows.where(F.col("is_train") & F.col("value").isNotNull())
    models = backward(chosen_terms(train, width, terms, margin), penalty)
    return rows.join(models, KEYS).select(*KEYS, "date", predicted(F.col("t"), F.col("z"), F.col("model")).alias("pred"))
