"""What the fitted models find, against searches, recursions and conditions of their optimum in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.base import CTES, Tables, query
from catalog import standins as s
from catalog.forecasts import SHIFT, VARIABLES, model_rows, national_history, rounded, split_rows
from wardwatch.forecast import arima, ets, evaluate, features as ft, hinges, models as md, run, trend
from wardwatch.plans import views
from wardwatch.session import settle

# --- hinges: every date of every series as a knot ------------------------------------------------------------------


def _knot_search() -> str:
    """Two steps of a search over all dates with ``MARGIN`` rows on either side."""
    margin, tiny = hinges.MARGIN, hinges.TINY
    ctes = [
        """hk_rows AS MATERIALIZED (SELECT series, variable, x, y, count(*) OVER w AS n, row_number() OVER (PARTITION BY series, variable ORDER BY x) AS i,
             y - avg(y) OVER w - regr_slope(y, x) OVER w * (x - avg(x) OVER w) AS r0, 1 / sqrt(count(*) OVER w) AS q1,
             (x - avg(x) OVER w) / sqrt(nullif(var_pop(x) OVER w * count(*) OVER w, 0)) AS q2, var_pop(y) OVER w * count(*) OVER w AS spread
           FROM (SELECT series, variable, value AS y, CAST(date - DATE '1970-01-01' AS DOUBLE) / 1000 AS x FROM fc_split WHERE is_train)
           WINDOW w AS (PARTITION BY series, variable))""",
        f"hk_knots AS MATERIALIZED (SELECT series, variable, x AS c FROM hk_rows WHERE i > {margin} AND n - i >= {margin})",
    ]
    rows = "hk_rows"
    for step in (1, 2):
        q = ["q1", "q2"] + ["q3"] * (step - 1)
        inner = ", ".join(f"sum((x - c) * {name}) AS h{name}" for name in q)
        left = " - ".join(["hh", *[f"h{name} * h{name}" for name in q]])
        ctes.append(
            f"""hk_best{step} AS MATERIALIZED (SELECT *, hr * hr / v AS gain FROM (SELECT *, {left} AS v FROM (
                  SELECT series, variable, c, any_value(spread) AS spread, sum((x - c) * (x - c)) AS hh, sum((x - c) * r{step - 1}) AS hr, {inner}
                  FROM hk_knots JOIN {rows} USING (series, variable) WHERE x > c GROUP BY series, variable, c))
                WHERE v > {tiny!r}::DOUBLE * hh AND hr * hr / v > 1e-10::DOUBLE * spread
                QUALIFY row_number() OVER (PARTITION BY series, variable ORDER BY gain DESC, c) = 1)"""
        )
        rest = " - ".join(["greatest(x - c, 0)", *[f"h{name} * {name}" for name in q]])
        ctes.append(
            f"""hk_rows{step} AS MATERIALIZED (SELECT series, variable, x, r{step - 1} - ({rest}) * hr / v AS r{step},
                  {', '.join(f't.{name}' for name in q)}, ({rest}) / sqrt(v) AS q{step + 2}, t.spread
                FROM {rows} t JOIN (SELECT * EXCLUDE (spread) FROM hk_best{step}) b USING (series, variable))"""
        )
        rows = f"hk_rows{step}"
    parts = [
        f"SELECT series, variable, {s} AS step, CAST(DATE '1970-01-01' + CAST(round(c * 1000) AS INTEGER) AS DATE) AS knot, round(gain / spread, 6) AS share FROM hk_best{s}"
        for s in (1, 2)
    ]
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(parts)


@query(_knot_search())
def hinge_knots(t: Tables) -> DataFrame:
    """The first two knots of each series by the forward pass, with the share of the variance that each removes."""
    number = (F.unix_date("date") / 1000).alias("t")
    train = split_rows(t).where("is_train").select(*ft.KEYS, "date", "value", number, F.array().cast("array<double>").alias("z"))
    found = hinges.chosen_terms(train, 0, terms=2).select(*ft.KEYS, "spread", F.posexplode("chosen").alias("i", "k"))
    return rounded(
        found.select(
            *ft.KEYS, (F.col("i") + 1).alias("step"), F.date_from_unix_date(F.round(F.col("k.c") * 1000).cast("int")).alias("knot"),
            (F.col("k.u") * F.col("k.u") / F.col("k.v") / F.col("spread")).alias("share"),
        ),
        "share",
    )


# --- autoregression: grid, differences, KPSS, first stage ----------------------------------------------------------

CTES["ar_grid"] = """
  SELECT series, variable, date, CASE WHEN v IS NOT NULL THEN v ELSE va + (vb - va) / (db - da) * (day - da) END AS y
  FROM (SELECT *, CAST(date - DATE '1970-01-01' AS DOUBLE) AS day,
          last_value(v IGNORE NULLS) OVER p AS va, last_value(CASE WHEN v IS NOT NULL THEN CAST(date - DATE '1970-01-01' AS DOUBLE) END IGNORE NULLS) OVER p AS da,
          first_value(v IGNORE NULLS) OVER f AS vb, first_value(CASE WHEN v IS NOT NULL THEN CAST(date - DATE '1970-01-01' AS DOUBLE) END IGNORE NULLS) OVER f AS db
        FROM (SELECT series, variable, CAST(unnest(range(min(date), max(date) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM fc_split WHERE is_train GROUP BY 1, 2)
        LEFT JOIN (SELECT series, variable, date, value AS v FROM fc_split WHERE is_train) USING (series, variable, date)
        WINDOW p AS (PARTITION BY series, variable ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               f AS (PARTITION BY series, variable ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
CTES["ar_strength"] = """
  SELECT series, variable, CAST(sum(n) AS BIGINT) AS days,
    CASE WHEN sum(n) >= 21 AND sum(off2) - sum(k) * pow(sum(k * m) / sum(k), 2) > 1e-9 * sum(off2)
      THEN (sum(k * m * m) - sum(k) * pow(sum(k * m) / sum(k), 2)) / (sum(off2) - sum(k) * pow(sum(k * m) / sum(k), 2)) ELSE 0 END AS strength
  FROM (SELECT series, variable, weekday, count(*) AS n, count(off) AS k, avg(off) AS m, sum(off * off) AS off2
        FROM (SELECT *, CAST(date - DATE '1970-01-01' AS BIGINT) % 7 AS weekday,
                CASE WHEN count(*) OVER w = 7 THEN y - avg(y) OVER w END AS off
              FROM ar_grid WINDOW w AS (PARTITION BY series, variable ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
        GROUP BY 1, 2, 3)
  GROUP BY 1, 2"""


def _difference(weekly: int, times: int) -> str:
    return " ".join(
        f"{'+' if c > 0 else '-'} {abs(c)!r} * {f'lag(y, {k}) OVER w' if k else 'y'}" for k, c in enumerate(arima.coefficients(weekly, times)) if c
    ).removeprefix("+ ")


CTES["ar_w"] = " UNION ALL ".join(
    f"""SELECT series, variable, date, {d} AS d, CASE WHEN strength > {arima.STRONG} THEN {_difference(1, d)} ELSE {_difference(0, d)} END AS w
        FROM ar_grid JOIN ar_strength USING (series, variable) WINDOW w AS (PARTITION BY series, variable ORDER BY date)"""
    for d in range(arima.MOST_DIFFERENCES + 1)
)
CTES["ar_kpss"] = """
  SELECT series, variable, d, max(n) AS n, max(l) AS lags, sum(s * s) / nullif(max(n) * max(lv), 0) AS kpss
  FROM (SELECT *, sum(e) OVER (PARTITION BY series, variable, d ORDER BY date ROWS UNBOUNDED PRECEDING) AS s
        FROM (SELECT *, w - avg(w) OVER p AS e, count(*) OVER p AS n, CAST(floor(3 * sqrt(count(*) OVER p) / 13) AS INTEGER) AS l,
                row_number() OVER (PARTITION BY series, variable, d ORDER BY date) AS i
              FROM ar_w WHERE w IS NOT NULL WINDOW p AS (PARTITION BY series, variable, d)))
  JOIN (SELECT series, variable, d, sum(e * e * CASE WHEN k = 0 THEN 1 ELSE 0 END + 2 * (1 - k / (l + 1.0)) * e * b * CASE WHEN k > 0 THEN 1 ELSE 0 END) AS lv
        FROM (SELECT a.series, a.variable, a.d, a.e, a.l, k, b.e AS b
              FROM (SELECT *, unnest(range(0, l + 1)) AS k FROM (
                      SELECT *, w - avg(w) OVER p AS e, CAST(floor(3 * sqrt(count(*) OVER p) / 13) AS INTEGER) AS l,
                        row_number() OVER (PARTITION BY series, variable, d ORDER BY date) AS i
                      FROM ar_w WHERE w IS NOT NULL WINDOW p AS (PARTITION BY series, variable, d))) a
              JOIN (SELECT *, w - avg(w) OVER (PARTITION BY series, variable, d) AS e, row_number() OVER (PARTITION BY series, variable, d ORDER BY date) AS i
                    FROM ar_w WHERE w IS NOT NULL) b
                ON a.series = b.series AND a.variable = b.variable AND a.d = b.d AND b.i = a.i - a.k)
        GROUP BY 1, 2, 3) USING (series, variable, d)
  GROUP BY 1, 2, 3"""


def known_grid(t: Tables) -> DataFrame:
    plain = split_rows(t).select(*ft.KEYS, "date", "value", "is_train", F.array().cast("array<double>").alias("x"))
    return settle(arima.daily_grid(plain))


@query(
    f"""SELECT series, variable, days, round(strength, 6) AS strength, d, n, lags, round(kpss, 6) AS kpss,
          d = coalesce(min(CASE WHEN coalesce(kpss, 0) <= {arima.KPSS_CRITICAL} THEN d END) OVER (PARTITION BY series, variable), {arima.MOST_DIFFERENCES}) AS chosen
        FROM ar_kpss JOIN ar_strength USING (series, variable)"""
)
def arima_differences(t: Tables) -> DataFrame:
    """How strong the weekly pattern is, the KPSS statistic after none, one and two differences, and which of these is taken."""
    grid = known_grid(t)
    strength = settle(arima.weekly_strength(grid))
    most = strength.agg(F.max("days")).first()[0] or 0
    tests = arima.kpss(arima.difference_rows(grid, strength), [*ft.KEYS, "d"], "w", most)
    rows = tests.join(strength, ft.KEYS).join(arima.differences(grid).select(*ft.KEYS, F.col("d").alias("best")), ft.KEYS)
    return rounded(rows.select(*ft.KEYS, "days", "strength", "d", "n", "lags", "kpss", (F.col("d") == F.col("best")).alias("chosen")), "strength", "kpss")


def _levinson(order: int) -> str:
    """The recursion written out, a sub-query for each order."""
    lags = ", ".join(f"sum(e * lag{k}) / count(*) AS g{k}" for k in range(1, order + 1))
    ctes = [
        f"""ar_gamma AS MATERIALIZED (SELECT series, variable, sum(e * e) / count(*) AS g0, {lags} FROM (
              SELECT *, {', '.join(f'lag(e, {k}) OVER (PARTITION BY series, variable ORDER BY date) AS lag{k}' for k in range(1, order + 1))}
              FROM (SELECT *, w - avg(w) OVER (PARTITION BY series, variable) AS e FROM ar_w
                    JOIN (SELECT series, variable, d FROM ar_kpss QUALIFY row_number() OVER (PARTITION BY series, variable
                            ORDER BY CASE WHEN coalesce(kpss, 0) <= {arima.KPSS_CRITICAL} THEN d ELSE {arima.MOST_DIFFERENCES} + (d < {arima.MOST_DIFFERENCES})::INT END) = 1) USING (series, variable, d)
                    WHERE w IS NOT NULL)) GROUP BY 1, 2)""",
        "ar_l0 AS MATERIALIZED (SELECT *, g0 AS left_ FROM ar_gamma)",
    ]
    for k in range(1, order + 1):
        known = " ".join(f"- p{j} * g{k - j}" for j in range(1, k))
        others = ", ".join(f"p{j}" for j in range(1, k))
        turned = "".join(f", p{j} - kappa * p{k - j} AS p{j}" for j in range(1, k))
        gammas = ", ".join(f"g{i}" for i in range(order + 1))
        ctes.append(
            f"""ar_l{k} AS MATERIALIZED (SELECT series, variable, {gammas}, left_ * (1 - kappa * kappa) AS left_{turned}, kappa AS p{k}
                FROM (SELECT series, variable, {gammas}, left_{', ' + others if others else ''},
                        CASE WHEN left_ > 1e-12 * g0 THEN (g{k} {known}) / left_ ELSE 0 END AS kappa FROM ar_l{k - 1}))"""
        )
    weights = ", ".join(f"p{k}" for k in range(1, order + 1))
    return (
        "WITH " + ",\n".join(ctes)
        + f"\nSELECT series, variable, CAST(lag AS INTEGER) AS lag, round(phi, 6) + 0.0 AS phi FROM (SELECT series, variable, unnest(range(1, {order + 1})) AS lag, unnest([{weights}]) AS phi FROM ar_l{order})"
    )


@query(_levinson(7))
def long_autoregression(t: Tables) -> DataFrame:
    """Coefficients of the first stage, here over a week."""
    grid = known_grid(t)
    plan = settle(arima.differences(grid))
    strength = plan.select(*ft.KEYS, F.col("weekly").cast("double").alias("strength"))
    w = arima.difference_rows(grid, strength).drop("weekly").join(plan.select(*ft.KEYS, "d"), [*ft.KEYS, "d"])
    phi = arima.levinson(F.col("gamma"), 7)
    rows = arima.autocovariances(w, 7).select(*ft.KEYS, F.posexplode(phi).alias("lag", "phi"))
    return rounded(rows.withColumn("lag", F.col("lag") + 1), "phi")


@query("SELECT series, variable, count(*) AS days, true AS optimal FROM ar_grid GROUP BY 1, 2")
def arima_is_optimal(t: Tables) -> DataFrame:
    """The normal equations of the chosen order: residuals are orthogonal to every lag, lagged residual and level in use.

    Series of less than ``SHORTEST`` days have no regression and count as optimal.
    """
    width = len(ft.LEVELS)
    x = settle(model_rows(t).withColumn("x", F.slice("x_linear", -width, width)))
    full = settle(arima.design(settle(arima.daily_grid(x, width)), width))
    known = full.where("NOT ahead").select(*ft.KEYS, "w", "f").join(arima.arima(x, width)[1], ft.KEYS)
    dot = F.aggregate(F.zip_with("beta", F.slice("f", 1, F.size("beta")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    each = known.select(*ft.KEYS, "days", (F.col("w") - dot).alias("r"), F.posexplode_outer("beta").alias("i", "b"), "f", "w")
    value = F.when(F.col("b") != 0, F.get("f", F.col("i")))
    sums = each.groupBy(*ft.KEYS, "i").agg(
        F.max("days").alias("days"), F.abs(F.sum(F.col("r") * value)).alias("off"), F.sum(F.abs("w") * F.abs(value)).alias("scale")
    )
    fine = F.coalesce(F.col("off") <= 1e-7 * F.col("scale") + 1e-9, F.lit(True))
    return sums.groupBy(*ft.KEYS).agg(F.max("days").alias("days"), F.min(fine).alias("optimal"))


# --- smoothing: states of fixed settings by recursion ---------------------------------------------------------------

FIXED = [ets.Setting(0.3, 0.1, 0.95, 0.2, ets.ADDED), ets.Setting(0.3, 0.1, 0.95, 0.2, ets.MULTIPLIED)]


def _states(season: int) -> str:
    """The recursion day by day, for all series at once."""
    w = FIXED[season - 1]
    ratio = season == ets.MULTIPLIED
    miss = "(y - b * s0)" if ratio else "(y - b - s0)"
    scaled = f"({miss} / s0)" if ratio else miss
    damped = f"({w.damp!r}::DOUBLE * (t + {w.alpha * w.beta!r}::DOUBLE * {scaled}))"
    later = f"s0 + {w.gamma * (1 - w.alpha)!r}::DOUBLE * {f'({miss} / b)' if ratio else miss}"
    first = ", ".join(f"v[{i + 1}] {'/' if ratio else '-'} m AS s{i}" for i in range(7))
    positive = "AND bool_and(y > 0)" if ratio else ""
    return f"""
      SELECT series, variable, i, n, b, t, err, s0, s1, s2, s3, s4, s5, s6 FROM (
        SELECT series, variable, 0 AS i, n, m AS b, 0.0::DOUBLE AS t, 0.0::DOUBLE AS err, {first}
        FROM (SELECT *, list_sum(v[1:7]) / 7 AS m FROM (SELECT series, variable, count(*) AS n, list(y ORDER BY date) AS v FROM ar_grid GROUP BY 1, 2 HAVING count(*) >= 21 {positive})))
      UNION ALL
      SELECT series, variable, i + 1, n, b + {w.alpha!r}::DOUBLE * {scaled} + {damped}, {damped}, err + {miss} * {miss}, s1, s2, s3, s4, s5, s6, {later}
      FROM es_state{season} JOIN es_rows USING (series, variable, i) WHERE i < n"""


_STATES = ", ".join(f"round({c}, 6) + 0.0 AS {a}" for c, a in [("b", "base"), ("t", "damped"), *[(f"s{i}", f"s{i}") for i in range(7)], ("err / n", "error")])
CTES["es_rows"] = "SELECT series, variable, y, row_number() OVER (PARTITION BY series, variable ORDER BY date) - 1 AS i FROM ar_grid"


@query(
    f"""WITH RECURSIVE es_state1 AS ({_states(1)}), es_state2 AS ({_states(2)})
        SELECT series, variable, 1 AS season, n AS days, {_STATES} FROM es_state1 WHERE i = n
        UNION ALL SELECT series, variable, 2, n, {_STATES} FROM es_state2 WHERE i = n AND isfinite(b)"""
)
def ets_states(t: Tables) -> DataFrame:
    """Level, trend and weekly season after the last value, with added and with multiplied seasons, for fixed weights."""
    rows = ets.last_states(ets.known_values(split_rows(t)), FIXED).where("s.season > 0")
    columns = [F.col("state.base"), F.col("state.damped"), *[F.col(f"state.s{i}") for i in range(7)], (F.col("state.error") / F.col("days")).alias("error")]
    found = rows.select(*ft.KEYS, F.col("s.season").alias("season"), "days", *columns)
    return rounded(found, "base", "damped", *[f"s{i}" for i in range(7)], "error")


# --- trend: the optimum, and bands ------------------------------------------------------------------------------------


@query("SELECT series, variable, count(*) AS n, true AS optimal FROM fc_split WHERE is_train GROUP BY 1, 2")
def trend_is_optimal(t: Tables) -> DataFrame:
    """Where the most likely parameters are, what the rows pull on each of them equals what its prior holds against it."""
    rows = settle(model_rows(t))
    models = trend.fit_trend(rows)
    train = rows.where("is_train").join(models, ft.KEYS)
    miss = F.col("value") / F.col("scale") - trend.dot(F.col("beta"), F.col("x_trend"))
    each = train.select(*ft.KEYS, "noise", "beta", "yearly", miss.alias("r"), F.posexplode("x_trend").alias("i", "x"))
    each = each.where(F.col("yearly") | ~F.col("i").between(trend.YEARLY.start, trend.YEARLY.stop - 1))
    pulls = each.groupBy(*ft.KEYS, "i").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("r") * F.col("x")) / F.max("noise")).alias("pull"),
        (F.sqrt(F.sum(F.col("x") * F.col("x"))) / F.sqrt(F.max("noise"))).alias("size"), F.max(F.get("beta", F.col("i"))).alias("b"),
    )
    change = F.col("i").between(trend.FIRST_CHANGE, trend.FIRST_CHANGE + ft.CHANGEPOINTS - 1)
    rounded_off = F.col("b") / (trend.SCALE_CHANGE * F.sqrt(F.col("b") * F.col("b") + trend.NEAR_ZERO**2))
    held = F.when(change, rounded_off).otherwise(F.col("b") / trend.SCALE_OTHER**2)
    fine = F.abs(F.col("pull") - held) <= 1e-4 * (1 + F.abs(held)) + 1e-6 * F.col("size")
    return pulls.groupBy(*ft.KEYS).agg(F.max("n").alias("n"), F.min(fine).alias("optimal"))


@query(
    """SELECT series, variable, count(*) AS days, true AS inside, true AS wider FROM fc_split
       GROUP BY series, variable, is_train HAVING NOT is_train"""
)
def trend_bands(t: Tables) -> DataFrame:
    """Simulated bands hold the forecast, and in their second half are wider than in their first."""
    rows = settle(model_rows(t))
    bands = trend.trend_bands(rows, trend.fit_trend(rows))
    place = F.percent_rank().over(ft.series_window().orderBy("date"))
    width = F.col("conf_hi") - F.col("conf_lo")
    marked = bands.withColumns({"late": place > 0.5, "width": width})
    return marked.groupBy(*ft.KEYS).agg(
        F.count(F.lit(1)).alias("days"), F.min((F.col("conf_lo") < F.col("value")) & (F.col("value") < F.col("conf_hi"))).alias("inside"),
        (F.avg(F.when(F.col("late"), F.col("width"))) > F.avg(F.when(~F.col("late"), F.col("width")))).alias("wider"),
    )


# --- elastic net, boosted trees, forest, the national view -----------------------------------------------------------


@query("SELECT series, variable, count(*) AS n, true AS optimal FROM fc_split WHERE is_train GROUP BY 1, 2")
def elastic_net_is_optimal(t: Tables) -> DataFrame:
    """At the optimum the rows pull on every coefficient in use with the sparse penalty, by its sign, and on the others with no more."""
    rows = settle(model_rows(t))
    train = rows.where("is_train").join(md.regression_weights(rows, md.ELASTIC_NET), ft.KEYS)
    miss = F.col("value") - trend.dot(F.col("beta"), F.col("x_fourier"))
    each = train.select(*ft.KEYS, "value", "beta", miss.alias("r"), F.posexplode("x_fourier").alias("i", "x")).where("i > 0")
    sums = each.groupBy(*ft.KEYS, "i").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("r", "x").alias("pull"), F.stddev_pop("x").alias("sd"), F.max(F.get("beta", F.col("i"))).alias("b"),
        F.stddev_pop("value").alias("size"), F.abs(F.avg("r")).alias("mean"),
    )
    pull, scaled = F.col("pull") / F.col("sd"), F.col("b") * F.col("sd")
    sparse, ridge = md.PENALTY * md.MIXTURE, md.PENALTY * (1 - md.MIXTURE)
    off = F.when(F.abs(scaled) > 1e-12, F.abs(pull - ridge * scaled - sparse * F.signum(scaled))).otherwise(F.greatest(F.abs(pull) - sparse, F.lit(0.0)))
    fine = F.when(F.col("sd") > 1e-9, off <= 1e-6 * (1 + F.col("size"))).otherwise(F.lit(True)) & (F.col("mean") <= 1e-6 * (1 + F.col("size")))
    return sums.groupBy(*ft.KEYS).agg(F.max("n").alias("n"), F.min(fine).alias("optimal"))


@query(
    """SELECT series, variable, count(*) FILTER (WHERE is_train) AS n_train, count(*) FILTER (WHERE NOT is_train) AS n_test, true AS bounded, true AS lower
       FROM fc_split GROUP BY 1, 2 HAVING bool_or(is_train)"""
)
def boosting_corrects(t: Tables) -> DataFrame:
    """Trees correct a base model within the sizes of its residuals, and lower the squared error of all training rows.

    A leaf is a mean of residuals; the first tree counts in full, the fourteen others by their rate.
    """
    rows = settle(model_rows(t))
    base = settle(md.fit_arima(rows))
    boosted = md.boost_residuals(rows, base, md.ARIMA_BOOSTED).select(*ft.KEYS, "date", "pred")
    both = rows.select(*ft.KEYS, "date", "value", "is_train").join(base.select(*ft.KEYS, "date", F.col("pred").alias("base")), [*ft.KEYS, "date"])
    both = settle(both.join(boosted, [*ft.KEYS, "date"]))
    train = both.where("is_train").select((F.col("value") - F.col("base")).alias("before"), (F.col("value") - F.col("pred")).alias("after"))
    whole = train.agg(F.max(F.abs("before")).alias("most"), (F.sum(F.col("after") ** 2) < F.sum(F.col("before") ** 2)).alias("lower"))
    most, lower = whole.select("most").scalar(), whole.select("lower").scalar()
    return both.groupBy(*ft.KEYS).agg(
        F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"),
        F.max(F.abs(F.col("pred") - F.col("base"))).alias("moved"),
    ).select(*ft.KEYS, "n_train", "n_test", (F.col("moved") <= most * (1 + 14 * 0.015)).alias("bounded"), lower.alias("lower"))


@query("SELECT series, variable, count(*) AS n, true AS inside FROM fc_split GROUP BY 1, 2")
def forest_stays_inside(t: Tables) -> DataFrame:
    """A leaf is a mean of training values, so every prediction lies between the least and the largest of them."""
    rows = settle(model_rows(t))
    fitted = settle(md.fit_forest(rows))
    train = rows.where("is_train").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    low, high = train.select("low").scalar(), train.select("high").scalar()
    return fitted.groupBy(*ft.KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("pred").alias("a"), F.max("pred").alias("b")).select(
        *ft.KEYS, "n", ((F.col("a") >= low) & (F.col("b") <= high)).alias("inside")
    )


@query(
    f"""WITH days AS (SELECT date + {SHIFT} AS date, CASE WHEN count(faelle_covid_aktuell) = count(*) THEN sum(faelle_covid_aktuell) END AS sum_covid,
               CASE WHEN count(faelle_covid_aktuell_beatmet) = count(*) THEN sum(faelle_covid_aktuell_beatmet) END AS sum_intub FROM icu_clean GROUP BY date),
       new AS (SELECT date + {SHIFT} AS date, sum(AnzFallErkrankung) AS n FROM history_daily WHERE BundeslandId = 0 GROUP BY date),
       ahead AS (SELECT CAST(max(date) + CAST(step AS INTEGER) AS DATE) AS date, true AS f FROM days, range(1, 15) AS s(step)
                 WHERE sum_covid IS NOT NULL AND sum_intub IS NOT NULL GROUP BY step)
       SELECT date, sum_covid, CAST(n AS BIGINT) AS new_cases, coalesce(f, false) AS has_forecast, coalesce(f, false) AS in_order
       FROM days FULL JOIN new USING (date) FULL JOIN ahead USING (date)"""
)
def germany_icu_axis(t: Tables) -> DataFrame:
    """The national view's dates: patients and new cases as they were, and forecasts whose bands hold their values on the fourteen days ahead."""
    result = run.create_forecasts(national_history(t), VARIABLES, [md.LINEAR, md.ETS])
    wide = evaluate.wide_forecast(result.forecast, VARIABLES).drop("series")
    history = s.case_history(t).withColumn("date", F.date_add("date", SHIFT))
    icu = s.icu_clean(t).withColumn("date", F.date_add("date", SHIFT))
    rows = views.germany_icu_with_forecast(icu, history, wide)
    value, low, high = (F.col(f"{c}_sum_covid") for c in ("value", "conf_lo", "conf_hi"))
    ordered = (low < value) & (value < high)
    return rows.select("date", F.col("sum_faelle_covid_aktuell").alias("sum_covid"), F.col("AnzFallErkrankung").alias("new_cases"), value.isNotNull().alias("has_forecast"), F.coalesce(ordered, F.lit(False)).alias("in_order"))
