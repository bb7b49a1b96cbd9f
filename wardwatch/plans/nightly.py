"""The tables of the nightly load, from cleaned feeds to stored facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwatch.operators.aggregates import cases_by_age, daily_totals
from wardwatch.operators.joins import join_case_history, join_population
from wardwatch.operators.measures import covid_share, incidence, occupancy, per_100k
from wardwatch.operators.reshape import densify
from wardwatch.operators.windows import (
    add_running_totals,
    fill_from_previous,
    new_from_cumulative,
    per_series,
    trailing_sum,
)
from wardwatch.functions.dates import restriction_level
from wardwatch.sources.tables import read_table, write_table


def case_history(cleaned: DataFrame, county: DataFrame) -> DataFrame:
    """New cases, seven-row sum and incidence per county and day.

    ``county`` holds the nation too. Aggregation, both windows and the join work on the county key.
    """
    window = per_series(["gemeinde"], "date")
    df = cleaned.withColumn("FallNeu", new_from_cumulative("KumFall", window))
    df = df.withColumn("Fall7d", trailing_sum("FallNeu", window))
    df = join_population(df, county)
    return df.withColumn("Incidence_7d_per_100k", incidence("Fall7d", "pop_all"))


def case_age(cleaned: DataFrame) -> DataFrame:
    """Cases and deaths per state, county, day and age group, with running totals."""
    keys = ["IdBundesland", "IdLandkreis", "Altersgruppe"]
    return add_running_totals(
        cases_by_age(cleaned), keys, "Refdatum", {"cases": "cumCases", "deaths": "cumDeaths"}
    )


def vaccination(cleaned: DataFrame) -> DataFrame:
    """Counts of every age group per day, county and dose, with running totals."""
    keys = ["IdLandkreis", "Altersgruppe", "vcCount"]
    return add_running_totals(densify(cleaned), keys, "date", {"count": "cum_count"})


def icu_metrics(cleaned: DataFrame, county: DataFrame) -> DataFrame:
    """Reports with population and bed measures."""
    return join_population(cleaned, county).withColumns(
        {
            "auslastung": occupancy("betten_belegt", "betten_frei"),
            "pct_covid": covid_share("faelle_covid_aktuell", "betten_belegt"),
            "covid_per_100k": per_100k("faelle_covid_aktuell", "pop_all"),
            "covid_per_100k_intubated": per_100k("faelle_covid_aktuell_beatmet", "pop_all"),
        }
    )


def icu_daily(cleaned: DataFrame, county: DataFrame, history: DataFrame) -> DataFrame:
    """Reports with population, bed measures and case history."""
    return join_case_history(icu_metrics(cleaned, county), history)


def county_names(icu: DataFrame) -> DataFrame:
    """One name per county key; the rows of a key agree on it, so the smallest will do."""
    return icu.groupBy("gemeinde").agg(F.min("name").alias("name"))


def forecast_input(icu: DataFrame, series: str = "national") -> DataFrame:
    """National day totals with restriction level and gaps in the incidence filled from the day before."""
    days = daily_totals(icu).dropna(subset=["sum_intub", "sum_covid"]).withColumn("series", F.lit(series))
    window = per_series(["series"], "date")
    return days.withColumns(
        {
            "lockdown_level": restriction_level("date"),
            "mean_7dIncidence": fill_from_previous("mean_7dIncidence", window),
        }
    )


def county_forecast_input(icu: DataFrame) -> DataFrame:
    """The same per county: one series for each."""
    days = icu.select(
        F.col("gemeinde").alias("series"),
        "date",
        F.col("faelle_covid_aktuell_beatmet").alias("sum_intub"),
        F.col("faelle_covid_aktuell").alias("sum_covid"),
        F.coalesce("AnzFallErkrankung", F.lit(0)).alias("sum_newCases"),
        F.coalesce("KumFall", F.lit(0)).alias("sum_cumCases"),
        F.col("Incidence_7d_per_100k").alias("mean_7dIncidence"),
    ).dropna(subset=["sum_intub", "sum_covid"])
    return days.withColumns(
        {
            "lockdown_level": restriction_level("date"),
            "mean_7dIncidence": fill_from_previous("mean_7dIncidence", per_series(["series"], "date")),
        }
    )


def store_cases(root: str, history: DataFrame, ages: DataFrame, doses: DataFrame, nowcast: DataFrame) -> None:
    """Write the tables of the case load. Run before ``store_icu``, which joins the stored history."""
    write_table(ages, root, "case_age", month_of="Refdatum")
    write_table(history, root, "case_history", month_of="date", sort_by=("gemeinde", "date"))
    write_table(doses, root, "vaccination", month_of="date")
    write_table(nowcast, root, "nowcast_r")


def store_icu(root: str, icu: DataFrame) -> None:
    """Write the tables of the ICU load; names come from the stored facts, not from a second run of the plan."""
    spark = icu.sparkSession
    write_table(icu, root, "icu_daily", month_of="date", sort_by=("gemeinde", "date"))
    write_table(county_names(read_table(spark, root, "icu_daily")), root, "county_names")
