"""Row selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def by_county(df: DataFrame, county: str, key: str = "gemeinde") -> DataFrame:
    """Rows of one county; a plain equality, so it reaches the Parquet scan."""
    return df.filter(F.col(key) == county)


def for_counties(df: DataFrame, county: str | None, key: str = "gemeinde") -> DataFrame:
    """All rows, or those of one county."""
    return df if county is None else by_county(df, county, key)


def latest_global(df: DataFrame, date: str = "date", dates: DataFrame | None = None) -> DataFrame:
    """Rows of the last date of the whole table.

    The date is a scalar subquery, so the filter moves below the joins and aggregates that made ``df``. ``dates`` may name
    a frame that has the same last date and is cheaper to read: the table before its joins, or its newest month.
    """
    return df.filter(F.col(date) == (df if dates is None else dates).agg(F.max(date)).scalar())


def latest_per_county(df: DataFrame, key: str = "gemeinde", date: str = "date") -> DataFrame:
    """Rows of each county's own last date, ties kept; ranks are cut before the shuffle."""
    window = Window.partitionBy(key).orderBy(F.col(date).desc())
    return df.withColumn("_rank", F.rank().over(window)).filter("_rank = 1").drop("_rank")


def last_n_days(df: DataFrame, days: int, key: str = "gemeinde", date: str = "date") -> DataFrame:
    """Rows of each county that are at most ``days`` days older than its last date."""
    last = F.max(date).over(Window.partitionBy(key))
    return df.withColumn("_last", last).filter(F.col(date) >= F.date_sub("_last", days)).drop("_last")


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def in_set(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(column).isin(values))


def national_only(df: DataFrame, state: str = "BundeslandId") -> DataFrame:
    return df.filter(F.col(state) == 0)
