"""Joins.

No side is force-broadcast: Spark broadcasts a side by its known or measured size and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwatch.operators.reshape import rbind


def join_population(facts: DataFrame, county: DataFrame, key: str = "gemeinde") -> DataFrame:
    """Add the county columns; facts of unknown counties stay."""
    return facts.join(county.withColumnRenamed("key", key), key, "left")


HISTORY_COLUMNS = [
    "BundeslandId",
    "AnzFallNeu",
    "AnzFallVortag",
    "AnzFallErkrankung",
    "AnzFallMeldung",
    "KumFall",
    "Fall7d",
    "Incidence_7d_per_100k",
]


def join_case_history(icu: DataFrame, history: DataFrame) -> DataFrame:
    """Add the case history of the same county and day."""
    return icu.join(history.select("date", "gemeinde", *HISTORY_COLUMNS), ["date", "gemeinde"], "left")


def join_zip(sites: DataFrame, zips: DataFrame, zip_column: str = "plz") -> DataFrame:
    """Add the county of each site's postcode. ``zips`` has one row per postcode."""
    codes = zips.select(F.col("zipcode").alias(zip_column), "community_code")
    return sites.join(codes, zip_column, "left")


def sites_with_sections(sites: DataFrame, sections: DataFrame, key: str = "id") -> DataFrame:
    """All reporting sections of the given sites."""
    return sites.select(key, "community_code").join(sections, key)


def lagged_regressors(
    future: DataFrame, history: DataFrame, columns: list[str], days: int = 14, key: str = "series"
) -> DataFrame:
    """Give each future date the values its series had ``days`` days before."""
    shifted = history.select(key, F.date_add("date", days).alias("date"), *columns)
    return future.join(shifted, [key, "date"], "left")


def forecast_context(forecast: DataFrame, history: DataFrame, future: DataFrame, columns: list[str],
                     key: str = "series") -> DataFrame:
    """Add the regressors of past and future dates to a forecast."""
    known = rbind(history.select(key, "date", *columns), future.select(key, "date", *columns))
    return forecast.join(known, [key, "date"], "left")
