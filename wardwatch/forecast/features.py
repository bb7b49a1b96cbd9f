"""Forecast rows and regressors, all as column expressions.

Rows are long: ``series``, ``variable``, ``date``, ``value``, ``lockdown_level``. A series has one row per day,
so its windows and groups are bounded by the number of days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwatch.functions.dates import restriction_level
from wardwatch.operators.joins import lagged_regressors

KEYS = ["series", "variable"]
LEVELS = (1, 2, 3)
CHANGEPOINTS = 20  # dates at which the trend's slope may change, in the first 80 % of the training span


def series_window():
    return Window.partitionBy(*KEYS)


def spread(rows: DataFrame) -> DataFrame:
    """Partition by series, in a number AQE leaves alone: fitting costs time per series, not per byte.

    The windows and the grouped fits that follow reuse this partitioning.
    """
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *KEYS)


def long_rows(history: DataFrame, variables: list[str]) -> DataFrame:
    """One row per series, variable and day."""
    kept = history.select("series", "date", "lockdown_level", *[F.col(v).cast("double").alias(v) for v in variables])
    return kept.unpivot(["series", "date", "lockdown_level"], variables, "variable", "value").dropna(subset=["value"])


def time_split(rows: DataFrame, weeks: int = 4) -> DataFrame:
    """Flag the last ``weeks`` weeks of each series as test rows, all rows before as training rows."""
    first_test = F.date_sub(F.max("date").over(series_window()), 7 * weeks)
    return rows.withColumn("is_train", F.col("date") <= first_test)


def future_dates(rows: DataFrame, days: int = 14, months: int | None = None) -> DataFrame:
    """The ``days`` days, or the days of so many calendar ``months``, after each series' last date."""
    last = rows.groupBy(*KEYS).agg(F.max("date").alias("last"))
    end = F.date_add("last", days) if months is None else F.add_months("last", months)
    return last.select(*KEYS, F.explode(F.sequence(F.date_add("last", 1), end)).alias("date"))


def future_dates_by_gap(rows: DataFrame, steps: int = 10) -> DataFrame:
    """``steps`` dates from the last date on, as far apart as the last two dates."""
    before = F.lag("date").over(series_window().orderBy("date"))
    gaps = rows.withColumn("gap", F.datediff("date", before))
    last = gaps.groupBy(*KEYS).agg(F.max_by(F.struct("date", "gap"), "date").alias("last"))
    numbers = F.sequence(F.lit(0), F.lit(steps - 1))
    return last.select(*KEYS, "last", F.explode(numbers).alias("step")).select(
        *KEYS, F.date_add("last.date", (F.col("step") * F.coalesce("last.gap", F.lit(1))).cast("int")).alias("date")
    )


def future_rows(rows: DataFrame, history: DataFrame, days: int = 14, level: int | None = None, months: int | None = None) -> DataFrame:
    """Rows to forecast, with the restriction level in force ``days`` days before, or a given constant one."""
    dates = future_dates(rows, days, months)
    if level is not None:
        return dates.withColumns({"lockdown_level": F.lit(level), "value": F.lit(None).cast("double")})
    ahead = lagged_regressors(dates, history, ["lockdown_level"], days)
    known = F.coalesce("lockdown_level", restriction_level(F.date_sub("date", days)))
    return ahead.select(*KEYS, "date", known.alias("lockdown_level"), F.lit(None).cast("double").alias("value"))


def calendar_features(rows: DataFrame) -> DataFrame:
    """Month and the date as a number, normalised by mean and deviation of the training rows."""
    number = F.unix_date("date").cast("double")
    train = F.when(F.col("is_train"), number)
    window = series_window()
    spread = F.stddev_samp(train).over(window)
    scaled = F.coalesce(F.try_divide(number - F.avg(train).over(window), spread), F.lit(0.0))
    return rows.withColumns({"month": F.month("date"), "date_num": scaled})


def date_signature(rows: DataFrame) -> DataFrame:
    """Calendar parts of the date."""
    parts = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "mday": F.dayofmonth,
        "wday": F.dayofweek, "yday": F.dayofyear, "week": F.weekofyear,
    }
    return rows.withColumns({name: part("date") for name, part in parts.items()})


def fourier_terms(period: float = 365, orders: int = 5) -> list[Column]:
    """Sine and cosine of the date for each order."""
    day = F.unix_date("date").cast("double")
    waves = []
    for k in range(1, orders + 1):
        angle = day * (2 * math.pi * k / period)
        waves += [F.sin(angle), F.cos(angle)]
    return waves


def fourier_features(rows: DataFrame, period: float = 365, orders: int = 5) -> DataFrame:
    names = [f"{w}{k}" for k in range(1, orders + 1) for w in ("sin", "cos")]
    return rows.withColumns(dict(zip(names, fourier_terms(period, orders))))


def dummies(column: str, values) -> list[Column]:
    """One 0/1 column per value."""
    return [F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values]


def _train_share() -> Column:
    """Position of a date in the training span: 0 at its first, 1 at its last day."""
    number, window = F.unix_date("date").cast("double"), series_window()
    train = F.when(F.col("is_train"), number)
    first, last = F.min(train).over(window), F.max(train).over(window)
    return F.coalesce(F.try_divide(number - first, last - first), F.lit(0.0))


def model_features(rows: DataFrame, changepoints: int = CHANGEPOINTS) -> DataFrame:
    """The regressors of all models as arrays of numbers.

    ``x_linear``: date, months, levels. ``x_trend``: broken trend, yearly and weekly waves, levels.
    ``x_fourier``: date signature, waves, dummies.
    """
    df = date_signature(calendar_features(rows)).withColumn("share", _train_share())
    one, months, levels = F.lit(1.0), dummies("month", range(2, 13)), dummies("lockdown_level", LEVELS)
    breaks = [F.greatest(F.col("share") - 0.8 * i / (changepoints + 1), F.lit(0.0)) for i in range(1, changepoints + 1)]
    parts = [F.col(c).cast("double") for c in ("year", "quarter", "mday", "yday", "week")]
    weekdays = dummies("wday", range(2, 8))
    arrays = {
        "x_linear": [one, F.col("date_num"), *months, *levels],
        "x_trend": [one, F.col("share"), *breaks, *fourier_terms(365.25, 10), *fourier_terms(7, 3), *levels],
        "x_fourier": [one, F.col("date_num"), *parts, *fourier_terms(365, 5), *months, *weekdays, *levels],
    }
    kept = [c for c in rows.columns]
    return df.select(*kept, "date_num", "month", *[F.array(*v).alias(k) for k, v in arrays.items()])


WEEKDAYS = 7


def weekly_pattern(rows: DataFrame) -> DataFrame:
    """Add ``pattern``: the median distance of the day of the week from a centred mean of seven days; 0 where no whole week is around.

    Days count, not rows: a week with a missing day gives no distance.
    """
    day = F.unix_date("date").cast("long")
    near = series_window().orderBy(day).rangeBetween(-3, 3)
    off = F.when(F.count("value").over(near) == WEEKDAYS, F.col("value") - F.avg("value").over(near))
    weekday = F.pmod(day, F.lit(WEEKDAYS))
    middle = F.percentile("_off", F.lit(0.5)).over(Window.partitionBy(*KEYS, "_weekday"))
    marked = rows.withColumns({"_off": off, "_weekday": weekday})
    return marked.withColumn("pattern", F.coalesce(middle, F.lit(0.0))).drop("_off", "_weekday")


def local_line(rows: DataFrame, column: str, radius: int, name: str) -> DataFrame:
    """Add the value at each date of the line through the days around it, by running moments; the mean where one day is known."""
    day = F.unix_date("date").cast("long")
    near = series_window().orderBy(day).rangeBetween(-radius, radius)
    # Seen from the row's own date, so that the moments stay small: x is the distance in days.
    own, x, y = day.cast("double"), F.when(F.col(column).isNotNull(), day.cast("double")), F.col(column)
    n, mx, my = F.count(y).over(near), F.avg(x).over(near), F.avg(y).over(near)
    slope = F.try_divide(F.covar_pop(x, y).over(near), F.var_pop(x).over(near))
    return rows.withColumn(name, F.when(n > 0, my + F.coalesce(slope, F.lit(0.0)) * (own - mx)))


def clean_outliers(rows: DataFrame, radius: int = 10, fence: float = 3.0) -> DataFrame:
    """Replace outliers and gaps of ``value`` by the line between their neighbours, with the weekly pattern of their day.

    The weekly pattern is taken out first. What remains is compared with a local line over ``radius`` days on either
    side; values outside the quartiles of that distance by ``fence`` times their range are set aside, the line is drawn again without
    them, and those outside the fence around it are outliers. Distances within rounding are none.
    """
    df = weekly_pattern(rows).withColumn("_adjusted", F.col("value") - F.col("pattern"))
    every = series_window()
    tiny = 1e-9 * (F.max(F.abs("value")).over(every) + 1)

    def outside(frame: DataFrame, line: str, name: str) -> DataFrame:
        frame = frame.withColumn("_off", F.col("_adjusted") - F.col(line))
        frame = frame.withColumn("_q", F.percentile("_off", F.array(F.lit(0.25), F.lit(0.75))).over(every))
        reach = (F.col("_q")[1] - F.col("_q")[0]) * fence + tiny
        return frame.withColumn(name, F.col("_off").between(F.col("_q")[0] - reach, F.col("_q")[1] + reach)).drop("_off", "_q")

    df = outside(local_line(df, "_adjusted", radius, "_line"), "_line", "_first")
    df = df.withColumn("_trusted", F.when(F.col("_first"), F.col("_adjusted")))
    df = outside(local_line(df, "_trusted", radius, "_again"), "_again", "_good")
    point = F.when(F.col("_good"), F.struct(F.unix_date("date").alias("d"), F.col("_adjusted").alias("v")))
    df = df.withColumn("_p", point)
    before = F.last("_p", ignorenulls=True).over(every.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_p", ignorenulls=True).over(every.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_a": before, "_b": after})
    a, b, day = F.col("_a"), F.col("_b"), F.unix_date("date")
    slope = F.coalesce(F.try_divide(b["v"] - a["v"], (b["d"] - a["d"]).cast("double")), F.lit(0.0))
    line = F.coalesce(a["v"] + slope * (day - a["d"]), a["v"], b["v"]) + F.col("pattern")
    clean = F.when(F.col("_good"), F.col("value")).otherwise(line)
    return df.withColumn("clean", clean).select(*rows.columns, "pattern", "clean")
