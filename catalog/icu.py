"""ICU reports: measures, national and state aggregates, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import standins as s
from catalog.base import Tables, half_even, query
from wardwatch.functions.dates import (
    NOTEBOOK_AFTERWARDS,
    NOTEBOOK_RESTRICTIONS,
    restriction_level as level_of,
)
from wardwatch.functions.nulls import strict_sum as strict
from wardwatch.operators import aggregates, clean, filters, joins, measures, reshape, windows
from wardwatch.plans import nightly


@query("SELECT * FROM icu_clean")
def resum_icu(t: Tables) -> DataFrame:
    return s.icu_clean(t)


@query("SELECT * FROM icu_metrics")
def icu_measures(t: Tables) -> DataFrame:
    """Population and all four bed measures."""
    return s.icu_metrics(t)


@query("SELECT * FROM icu_daily")
def icu_daily_load(t: Tables) -> DataFrame:
    """The whole ICU table: re-sum, population, measures, case history."""
    return s.icu_daily(t)


@query("SELECT date, gemeinde, auslastung FROM icu_metrics")
def occupancy(t: Tables) -> DataFrame:
    return s.icu_clean(t).select("date", "gemeinde", measures.occupancy("betten_belegt", "betten_frei").alias("auslastung"))


@query("SELECT date, gemeinde, pct_covid FROM icu_metrics")
def covid_share(t: Tables) -> DataFrame:
    return s.icu_clean(t).select(
        "date", "gemeinde", measures.covid_share("faelle_covid_aktuell", "betten_belegt").alias("pct_covid")
    )


@query("SELECT date, gemeinde, covid_per_100k, covid_per_100k_intubated FROM icu_metrics")
def per_100k(t: Tables) -> DataFrame:
    df = joins.join_population(s.icu_clean(t), s.county(t).select("key", "pop_all"))
    return df.select(
        "date",
        "gemeinde",
        measures.per_100k("faelle_covid_aktuell", "pop_all").alias("covid_per_100k"),
        measures.per_100k("faelle_covid_aktuell_beatmet", "pop_all").alias("covid_per_100k_intubated"),
    )


@query(
    """SELECT date, gemeinde, faelle_covid_aktuell, AnzFallErkrankung, KumFall, Fall7d, Incidence_7d_per_100k
       FROM icu_daily"""
)
def join_case_history(t: Tables) -> DataFrame:
    return joins.join_case_history(s.icu_clean(t), s.case_history(t)).select(
        "date", "gemeinde", "faelle_covid_aktuell", "AnzFallErkrankung", "KumFall", "Fall7d", "Incidence_7d_per_100k"
    )


@query(
    """SELECT date,
         CASE WHEN count(faelle_covid_aktuell_beatmet) = count(*) THEN sum(faelle_covid_aktuell_beatmet) END AS sum_intub,
         CASE WHEN count(faelle_covid_aktuell) = count(*) THEN sum(faelle_covid_aktuell) END AS sum_covid,
         CAST(coalesce(sum(AnzFallErkrankung), 0) AS BIGINT) AS sum_newCases,
         CAST(coalesce(sum(KumFall), 0) AS BIGINT) AS sum_cumCases,
         round(avg(Incidence_7d_per_100k), 6) AS mean_7dIncidence
       FROM icu_daily GROUP BY date"""
)
def daily_totals(t: Tables) -> DataFrame:
    days = aggregates.daily_totals(s.icu_daily(t))
    return days.withColumn("mean_7dIncidence", F.round("mean_7dIncidence", 6))


@query(
    f"""SELECT date, {s.sql_strict('area').replace('AS area', 'AS sum_area')},
         CAST({s.sql_strict('pop_all').replace(' AS pop_all', '')} AS BIGINT) AS sum_pop,
         {s.sql_strict('anzahl_standorte').replace('AS anzahl', 'AS sum')},
         {s.sql_strict('betten_frei').replace('AS betten_frei', 'AS sum_free_beds')},
         {s.sql_strict('betten_belegt').replace('AS betten_belegt', 'AS sum_occup_beds')}
        FROM icu_metrics GROUP BY date"""
)
def national_stats(t: Tables) -> DataFrame:
    return aggregates.national_stats(s.icu_metrics(t))


@query(
    f"""SELECT date, {s.sql_strict('faelle_covid_aktuell').replace('AS faelle', 'AS sum_faelle')},
         {s.sql_strict('faelle_covid_aktuell_beatmet').replace('AS faelle', 'AS sum_faelle')}
        FROM icu_clean GROUP BY date"""
)
def national_icu(t: Tables) -> DataFrame:
    return aggregates.national_icu(s.icu_clean(t))


@query(
    f"""SELECT date, f AS sum_betten_frei, b AS sum_betten_belegt, c AS sum_faelle_covid_aktuell,
              {half_even('c / nullif(b, 0) * 100', 1)} AS pct_covid,
              {half_even('b / nullif(f + b, 0) * 100', 1)} AS auslastung
       FROM (SELECT date, sum(betten_frei) AS f, sum(betten_belegt) AS b,
                    CASE WHEN count(faelle_covid_aktuell) = count(*) THEN sum(faelle_covid_aktuell) END AS c
             FROM icu_clean GROUP BY date)"""
)
def national_occupancy(t: Tables) -> DataFrame:
    return aggregates.national_occupancy(s.icu_clean(t))


@query(
    f"""SELECT date, bundesland, {s.sql_strict('faelle_covid_aktuell').replace('AS faelle', 'AS sum_faelle')}
        FROM icu_clean WHERE bundesland IS NOT NULL GROUP BY 1, 2"""
)
def state_icu(t: Tables) -> DataFrame:
    return aggregates.state_icu(s.icu_clean(t))


@query(
    """SELECT gemeinde, any_value(name) AS name FROM icu_metrics GROUP BY gemeinde"""
)
def county_names(t: Tables) -> DataFrame:
    return nightly.county_names(s.icu_metrics(t))


@query("SELECT DISTINCT name AS label, gemeinde AS value FROM icu_metrics WHERE name IS NOT NULL")
def name_key_map(t: Tables) -> DataFrame:
    return clean.name_key_map(filters.not_null(s.icu_metrics(t), "name"))


@query(
    """SELECT date, gemeinde, parameter, value FROM icu_clean
       UNPIVOT INCLUDE NULLS (value FOR parameter IN (betten_frei, betten_belegt))"""
)
def pivot_beds_long(t: Tables) -> DataFrame:
    return reshape.pivot_beds_long(s.icu_clean(t).select("date", "gemeinde", "betten_frei", "betten_belegt"))


_SQL_STEPS = " ".join(f"WHEN d <= DATE '{day}' THEN {level}" for day, level in (
    ("2020-03-23", 0), ("2020-05-03", 3), ("2020-11-02", 1), ("2020-12-16", 2),
    ("2021-03-04", 3), ("2021-04-19", 2), ("2021-05-01", 1), ("2021-08-07", 0)))
_SQL_NOTEBOOK = " ".join(f"WHEN d <= DATE '{day}' THEN {level}" for day, level in (
    ("2020-03-23", 0), ("2020-05-03", 3), ("2020-11-02", 1), ("2020-12-16", 2)))


@query(
    f"""SELECT date, CAST(CASE {_SQL_STEPS} ELSE 1 END AS INTEGER) AS level,
               CAST(CASE {_SQL_NOTEBOOK} ELSE 3 END AS INTEGER) AS notebook_level
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date,
                     CAST(l_shipdate AS DATE) + 8000 AS d FROM lineitem)"""
)
def restriction_level(t: Tables) -> DataFrame:
    """Ship dates moved on by 8,000 days, so that they span all steps."""
    days = t.lineitem.select(F.to_date("l_shipdate").alias("date")).distinct()
    moved = F.date_add("date", 8000)
    return days.select(
        "date",
        level_of(moved).alias("level"),
        level_of(moved, NOTEBOOK_RESTRICTIONS, NOTEBOOK_AFTERWARDS).alias("notebook_level"),
    )


@query(
    """SELECT gemeinde, date, x, coalesce(x, lag(x) OVER (PARTITION BY gemeinde ORDER BY date)) AS filled
       FROM (SELECT gemeinde, date, faelle_covid_aktuell AS x FROM icu_clean)"""
)
def fill_from_previous(t: Tables) -> DataFrame:
    rows = s.icu_clean(t).select("gemeinde", "date", F.col("faelle_covid_aktuell").alias("x"))
    window = windows.per_series(["gemeinde"], "date")
    return rows.withColumn("filled", windows.fill_from_previous("x", window))


@query(
    """SELECT bundesland, CASE bundesland WHEN 1 THEN 'Schleswig-Holstein' WHEN 2 THEN 'Hamburg'
              WHEN 3 THEN 'Niedersachsen' WHEN 4 THEN 'Bremen' END AS state_name, CAST(count(*) AS BIGINT) AS days
       FROM (SELECT DISTINCT date, bundesland FROM icu_clean) GROUP BY 1, 2"""
)
def state_name(t: Tables) -> DataFrame:
    days = s.icu_clean(t).select("date", "bundesland").distinct()
    return days.groupBy("bundesland", clean.state_name("bundesland").alias("state_name")).agg(
        F.count(F.lit(1)).alias("days")
    )


@query(
    """SELECT gemeinde, name, bundesland, anzahl_standorte, pct_covid, false AS is_missing
       FROM icu_metrics WHERE date = (SELECT max(date) FROM icu_metrics)
       UNION ALL SELECT * FROM (VALUES
         ('07338', 'Rhein-Pfalz-Kreis', 7.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, true),
         ('09374', 'Landkreis neustadt an der Waldnaab', 9.0, 0.0, NULL, true),
         ('09473', 'Landkreis Coburg', 9.0, 0.0, NULL, true),
         ('09573', 'Landkreis Fürth', 9.0, 0.0, NULL, true))"""
)
def add_missing_counties(t: Tables) -> DataFrame:
    day = reshape.add_missing_counties(filters.latest_global(s.icu_metrics(t)))
    return day.select("gemeinde", "name", "bundesland", "anzahl_standorte", "pct_covid", "is_missing")


@query(
    """SELECT o_orderstatus AS k, CAST(count(*) AS BIGINT) AS n, sum(x) AS skipping,
              CASE WHEN count(x) = count(*) THEN sum(x) END AS strict, coalesce(sum(y), 0) AS or_zero
       FROM (SELECT o_orderstatus, CAST(CASE WHEN o_orderstatus <> 'P' OR o_custkey % 50 <> 0 THEN o_custkey END AS DOUBLE) AS x,
                    CAST(CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS DOUBLE) AS y FROM orders)
       GROUP BY 1"""
)
def null_rules(t: Tables) -> DataFrame:
    """Three sums with three null rules."""
    from wardwatch.functions.nulls import sum_or_zero

    status, number = F.col("o_orderstatus"), F.col("o_custkey").cast("double")
    rows = t.orders.select(
        status.alias("k"),
        F.when((status != "P") | (F.col("o_custkey") % 50 != 0), number).alias("x"),
        F.when(status == "F", number).alias("y"),
    )
    return rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("skipping"), strict("x").alias("strict"),
        sum_or_zero("y").alias("or_zero"),
    )


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS menge, l_shipdate_text, l_returnflag
       FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate_text FROM lineitem)
       WHERE l_returnflag IN ('A', 'R') AND starts_with(l_shipdate_text, '199') AND ends_with(l_shipdate_text, '1')"""
)
def select_rename_relocate(t: Tables) -> DataFrame:
    """Column choice, renames, order and the plain row filters."""
    df = t.lineitem.select("l_quantity", "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    df = filters.in_set(df, "l_returnflag", ["A", "R"])
    df = df.withColumn("l_shipdate_text", F.to_date("l_shipdate").cast("string")).drop("l_shipdate")
    text = F.col("l_shipdate_text")
    df = filters.not_null(df.filter(text.startswith("199") & text.endswith("1")), "l_orderkey")
    names = ["l_orderkey", "l_partkey", "l_linenumber"]
    df = clean.relocate(df, *names)
    return clean.rename_all(df, [*names, "menge", "l_returnflag", "l_shipdate_text"])


@query(
    """SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'NA' WHEN event_id % 11 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS a,
              TRY_CAST(event_type AS DOUBLE) AS b FROM events"""
)
def cast_many(t: Tables) -> DataFrame:
    number = F.col("event_id")
    text = F.when(number % 7 == 0, "NA").when(number % 11 == 0, "").otherwise(F.col("value").cast("string"))
    return clean.cast_many(t.events.select("event_id", text.alias("a"), F.col("event_type").alias("b")), ["a", "b"])


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_shipmark, CAST(NULL AS VARCHAR) AS o_orderstatus
       FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmark FROM lineitem)
       UNION ALL SELECT o_orderkey, CAST(NULL AS INTEGER), o_totalprice, CAST(NULL AS VARCHAR), o_orderstatus FROM orders"""
)
def bind_rows(t: Tables) -> DataFrame:
    """Frames with different columns under one another."""
    left = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", F.concat("l_returnflag", "l_linestatus").alias("l_shipmark")
    )
    right = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("l_quantity"), "o_orderstatus"
    )
    return reshape.bind_rows(left, right)


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag <> 'A' THEN l_partkey END, l_suppkey) AS key
       FROM lineitem"""
)
def coalesce_columns(t: Tables) -> DataFrame:
    """A column filled from another one, which is dropped."""
    key = F.when(F.col("l_returnflag") != "A", F.col("l_partkey"))
    df = t.lineitem.select("l_orderkey", "l_linenumber", key.alias("key"), F.col("l_suppkey").alias("older"))
    return clean.fill_column(df, "key", "older")


@query("SELECT c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def rbind(t: Tables) -> DataFrame:
    """Frames with the same columns under one another."""
    return reshape.rbind(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")),
    )


@query("SELECT gemeinde, date, betten_frei FROM icu_clean ORDER BY gemeinde, date")
def arrange(t: Tables) -> DataFrame:
    """Rows in order of county and date: a range-partitioned sort of the final output."""
    return s.icu_clean(t).select("gemeinde", "date", "betten_frei").orderBy("gemeinde", "date")
