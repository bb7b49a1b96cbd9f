"""Case history, cases by age, vaccinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import standins as s
from catalog.base import Tables, query
from wardwatch.functions.nulls import percent
from wardwatch.operators import aggregates, filters, joins, reshape, windows
from wardwatch.operators.measures import incidence
from wardwatch.plans import nightly, views
from wardwatch.sources import feeds

def by_date():
    return windows.per_series(["gemeinde"], "date")


@query(
    """SELECT gemeinde, date, KumFall, FallNeu, Fall7d, pop_all, Incidence_7d_per_100k FROM case_history"""
)
def weekly_incidence(t: Tables) -> DataFrame:
    """Running total, new cases, seven-row sum and incidence per county and day."""
    return s.case_history(t).select(
        "gemeinde", "date", "KumFall", "FallNeu", "Fall7d", "pop_all", "Incidence_7d_per_100k"
    )


@query("SELECT * FROM case_history")
def case_history_load(t: Tables) -> DataFrame:
    """The history table from raw attributes: boroughs merged, re-summed, keys padded, epoch dates."""
    return nightly.case_history(feeds.clean_history(s.history_attributes(t)), s.county_and_nation(t))


@query("SELECT gemeinde, date, BundeslandId, AnzFallNeu, AnzFallVortag, AnzFallErkrankung, AnzFallMeldung, KumFall FROM history_daily")
def resum_history(t: Tables) -> DataFrame:
    return feeds.clean_history(s.history_attributes(t))


@query("SELECT gemeinde, date, KumFall - lag(KumFall, 1, 0) OVER (PARTITION BY gemeinde ORDER BY date) AS FallNeu FROM history_daily")
def new_from_cumulative(t: Tables) -> DataFrame:
    return s.history_daily(t).select("gemeinde", "date", windows.new_from_cumulative("KumFall", by_date()).alias("FallNeu"))


@query(
    """SELECT gemeinde, date, CAST(sum(AnzFallErkrankung) OVER (PARTITION BY gemeinde ORDER BY date
         ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS last7rows,
       CAST(sum(AnzFallErkrankung) OVER (PARTITION BY gemeinde ORDER BY date
         RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS last7days
       FROM history_daily"""
)
def trailing_sum(t: Tables) -> DataFrame:
    """Seven rows as the nightly load counts them, next to seven calendar days."""
    return s.history_daily(t).select(
        "gemeinde",
        "date",
        windows.trailing_sum("AnzFallErkrankung", by_date()).alias("last7rows"),
        windows.trailing_sum_days("AnzFallErkrankung", ["gemeinde"], "date").alias("last7days"),
    )


@query(
    """SELECT gemeinde, date, CASE WHEN count(x) OVER w = count(*) OVER w THEN sum(x) OVER w END AS strict7
       FROM (SELECT gemeinde, date, faelle_covid_aktuell AS x FROM icu_clean)
       WINDOW w AS (PARTITION BY gemeinde ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
)
def trailing_sum_with_nulls(t: Tables) -> DataFrame:
    return s.icu_clean(t).select(
        "gemeinde", "date", windows.trailing_sum("faelle_covid_aktuell", by_date()).alias("strict7")
    )


@query(
    """SELECT gemeinde, date, BundeslandId, Fall7d, pop_all, name,
              Fall7d / (pop_all / 100000.0::DOUBLE) AS incidence FROM case_history"""
)
def join_population(t: Tables) -> DataFrame:
    df = s.history_daily(t).withColumn("FallNeu", windows.new_from_cumulative("KumFall", by_date()))
    df = joins.join_population(df.withColumn("Fall7d", windows.trailing_sum("FallNeu", by_date())), s.county_and_nation(t))
    return df.select(
        "gemeinde", "date", "BundeslandId", "Fall7d", "pop_all", "name", incidence("Fall7d", "pop_all").alias("incidence")
    )


@query("SELECT * FROM age_daily")
def cases_by_age(t: Tables) -> DataFrame:
    return aggregates.cases_by_age(s.case_rows(t))


@query("SELECT * FROM case_age")
def cumulative_cases(t: Tables) -> DataFrame:
    return s.case_age(t)


@query(
    """SELECT IdLandkreis, Refdatum, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths
       FROM age_daily GROUP BY 1, 2"""
)
def county_daily(t: Tables) -> DataFrame:
    return aggregates.county_daily(aggregates.cases_by_age(s.case_rows(t)))


@query(
    """SELECT IdLandkreis, Refdatum, cases, deaths, CAST(sum(cases) OVER w AS BIGINT) AS cumCases,
              CAST(sum(deaths) OVER w AS BIGINT) AS cumDeaths
       FROM (SELECT IdLandkreis, Refdatum, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(deaths) AS BIGINT) AS deaths
             FROM age_daily GROUP BY 1, 2)
       WINDOW w AS (PARTITION BY IdLandkreis ORDER BY Refdatum)"""
)
def cumulative_county(t: Tables) -> DataFrame:
    daily = aggregates.county_daily(aggregates.cases_by_age(s.case_rows(t)))
    return windows.add_running_totals(
        daily, ["IdLandkreis"], "Refdatum", {"cases": "cumCases", "deaths": "cumDeaths"}
    )


@query("SELECT * FROM county_and_nation")
def national_total_row(t: Tables) -> DataFrame:
    return s.county_and_nation(t)


@query("SELECT * FROM county WHERE key IS NOT NULL AND name IS NOT NULL")
def load_county_dim(t: Tables) -> DataFrame:
    """Dimension rows by position; those without key or name go."""
    bad = s.county(t).withColumn("key", F.lit(None).cast("string"))
    return feeds.load_county_dim(reshape.bind_rows(s.county(t), bad).toDF(*[f"X{n}" for n in range(1, 10)]))


@query(
    """SELECT date, IdLandkreis, vcCount,
         sum(count) FILTER (WHERE Altersgruppe = 'click')::BIGINT AS click,
         sum(count) FILTER (WHERE Altersgruppe = 'error')::BIGINT AS error,
         sum(count) FILTER (WHERE Altersgruppe = 'purchase')::BIGINT AS purchase,
         sum(count) FILTER (WHERE Altersgruppe = 'signup')::BIGINT AS signup,
         sum(count) FILTER (WHERE Altersgruppe = 'view')::BIGINT AS view
       FROM vaccination_rows GROUP BY 1, 2, 3"""
)
def pivot_age_wide(t: Tables) -> DataFrame:
    return reshape.pivot_age_wide(s.vaccination_rows(t), s.AGES, ["date", "IdLandkreis", "vcCount"])


@query("SELECT * FROM vaccination_dense")
def densify(t: Tables) -> DataFrame:
    return reshape.densify(s.vaccination_rows(t))


@query("SELECT * FROM vaccination")
def cumulative_doses(t: Tables) -> DataFrame:
    return s.vaccination(t)


@query(
    """SELECT IdLandkreis, vcCount, date, CAST(sum(cum_count) AS BIGINT) AS cum_count
       FROM vaccination GROUP BY 1, 2, 3"""
)
def dose_totals(t: Tables) -> DataFrame:
    return aggregates.dose_totals(s.vaccination(t))


@query(
    """SELECT IdLandkreis, vcCount, date, cum_count, cum_count / pop_all::DOUBLE * 100 AS pct_vac
       FROM (SELECT IdLandkreis, vcCount, date, CAST(sum(cum_count) AS BIGINT) AS cum_count
             FROM vaccination GROUP BY 1, 2, 3)
       LEFT JOIN county ON key = IdLandkreis"""
)
def vaccinated_pct(t: Tables) -> DataFrame:
    return views.county_vaccinated_pct(s.vaccination(t), s.county(t))


@query(
    """SELECT date, IdLandkreis, Altersgruppe,
         max(count) FILTER (WHERE vcCount = 1) AS count_Vac1, max(cum_count) FILTER (WHERE vcCount = 1) AS cum_count_Vac1,
         max(count) FILTER (WHERE vcCount = 2) AS count_Vac2, max(cum_count) FILTER (WHERE vcCount = 2) AS cum_count_Vac2,
         max(count) FILTER (WHERE vcCount = 3) AS count_Vac3, max(cum_count) FILTER (WHERE vcCount = 3) AS cum_count_Vac3
       FROM vaccination GROUP BY 1, 2, 3"""
)
def pivot_dose_wide(t: Tables) -> DataFrame:
    """Also the county vaccination view."""
    return views.county_vaccination(s.vaccination(t))


@query(
    """SELECT gemeinde, date, Incidence_7d_per_100k AS x,
              (Incidence_7d_per_100k - lag(Incidence_7d_per_100k) OVER w)
              / nullif(lag(Incidence_7d_per_100k) OVER w, 0) * 100 AS pct
       FROM case_history WINDOW w AS (PARTITION BY gemeinde ORDER BY date)"""
)
def pct_change(t: Tables) -> DataFrame:
    return s.case_history(t).select(
        "gemeinde",
        "date",
        F.col("Incidence_7d_per_100k").alias("x"),
        windows.pct_change("Incidence_7d_per_100k", by_date()).alias("pct"),
    )


@query("SELECT date, gemeinde, AnzFallErkrankung, KumFall FROM history_daily WHERE BundeslandId = 0")
def national_only(t: Tables) -> DataFrame:
    return filters.national_only(s.history_daily(t)).select("date", "gemeinde", "AnzFallErkrankung", "KumFall")


@query("SELECT date, gemeinde, AnzFallErkrankung, KumFall FROM history_daily WHERE gemeinde = '05000'")
def by_county(t: Tables) -> DataFrame:
    return filters.by_county(s.history_daily(t), "05000").select("date", "gemeinde", "AnzFallErkrankung", "KumFall")


@query("SELECT date, gemeinde, KumFall FROM history_daily WHERE date = (SELECT max(date) FROM history_daily)")
def latest_global(t: Tables) -> DataFrame:
    return filters.latest_global(s.history_daily(t)).select("date", "gemeinde", "KumFall")


@query("SELECT gemeinde, date, KumFall FROM history_daily QUALIFY date = max(date) OVER (PARTITION BY gemeinde)")
def latest_per_county(t: Tables) -> DataFrame:
    return filters.latest_per_county(s.history_daily(t)).select("gemeinde", "date", "KumFall")


@query(
    """SELECT gemeinde, date, KumFall FROM history_daily
       QUALIFY date >= max(date) OVER (PARTITION BY gemeinde) - INTERVAL 1 DAY"""
)
def last_n_days(t: Tables) -> DataFrame:
    return filters.last_n_days(s.history_daily(t), 1).select("gemeinde", "date", "KumFall")


@query("SELECT max(date) AS max_date FROM history_daily")
def max_date(t: Tables) -> DataFrame:
    return aggregates.max_date(s.history_daily(t))


@query(
    """SELECT raw AS old_key, key AS new_key, CAST(count(*) AS BIGINT) AS rows FROM (
         SELECT CASE WHEN nation = 9 THEN CASE number % 4 WHEN 0 THEN '9463' WHEN 1 THEN '9563'
                                               WHEN 2 THEN '9473' ELSE '9573' END
                     WHEN nation = 11 THEN '110' || lpad(CAST(number % 12 + 1 AS VARCHAR), 2, '0')
                     ELSE CAST(nation * 1000 AS VARCHAR) END AS raw,
                CASE WHEN nation = 9 THEN CASE WHEN number % 2 = 0 THEN '09463' ELSE '09563' END
                     WHEN nation = 11 THEN '11000'
                     WHEN nation BETWEEN 1 AND 8 THEN '0' || CAST(nation * 1000 AS VARCHAR)
                     ELSE CAST(nation * 1000 AS VARCHAR) END AS key
         FROM case_events)
       GROUP BY 1, 2"""
)
def merge_counties(t: Tables) -> DataFrame:
    raw = s.case_key(F.col("nation"), F.col("number")).alias("old_key")
    keyed = s.case_events(t).select(raw)
    merged = s.merge_county_key(s.pad_county_key("old_key"), s.BERLIN_BOROUGHS, s.BAVARIAN_MERGERS)
    return keyed.groupBy("old_key", merged.alias("new_key")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    """SELECT c_custkey, CASE WHEN length(k) = 4 THEN '0' || k ELSE k END AS padded,
              CASE WHEN length(k) = 4 AND k NOT LIKE '0%' THEN '0' || k ELSE k END AS padded_report,
              100.0::DOUBLE * c_custkey / nullif(c_nationkey, 0) AS share
       FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0')
                            ELSE CAST(c_custkey AS VARCHAR) END AS k FROM customer)"""
)
def pad_county_key(t: Tables) -> DataFrame:
    number = F.col("c_custkey").cast("string")
    key = F.when((F.col("c_custkey") % 3 == 0) & (F.length(number) < 4), F.lpad(number, 4, "0")).otherwise(number)
    return t.customer.withColumn("k", key).select(
        "c_custkey",
        s.pad_county_key("k").alias("padded"),
        s.pad_report_key("k").alias("padded_report"),
        percent("c_custkey", "c_nationkey").alias("share"),
    )
