"""The report views, each over all counties."""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalog import standins as s
from catalog.base import Tables, half_even, query
from catalog.texts import sql_number
from wardwatch.plans import views

_ICU_TODAY = "(SELECT * FROM icu_metrics WHERE date = (SELECT max(date) FROM icu_metrics))"


@query(
    f"""SELECT i.gemeinde, 'Gemeinde: ' || coalesce(name, 'NA') || '<br />Fläche: '
         || coalesce(translate(format('{{:,.2f}}', area), ',.', '.,'), 'NA') || 'km²<br />Einwohner: '
         || coalesce(translate(format('{{:,}}', pop_all), ',.', '.,'), 'NA') || '<br />Standorte: '
         || {sql_number('anzahl_standorte')} || '<br />Betten(frei/gesamt): ' || {sql_number('betten_frei')} || '/'
         || {sql_number('(betten_frei + betten_belegt)')} || '<br />7-Tage Inzidenz: '
         || {sql_number('h.inc')} || 'Fälle/100.000 Einwohner<br />Aktualisiert(DIVI): ' || daten_stand
         || '<br />Aktualisiert(RKI): ' || coalesce(CAST(h.day AS VARCHAR), 'NA') AS card
        FROM {_ICU_TODAY} i
        LEFT JOIN (SELECT gemeinde, date AS day, {half_even('Incidence_7d_per_100k', 0)} AS inc
                   FROM case_history WHERE date = (SELECT max(date) FROM case_history)) h
          ON h.gemeinde = i.gemeinde"""
)
def county_stats(t: Tables) -> DataFrame:
    return views.county_stats(s.icu_metrics(t), s.case_history(t), None, s.report_days(t), s.case_days(t))


@query(
    f"""SELECT gemeinde, date, inc_today, change,
          'Inzidenz heute: ' || {sql_number('inc_today')} || '(' ||
          CASE WHEN change IS NULL THEN 'NA' ELSE CASE WHEN change > 0 THEN '+' ELSE '' END || {sql_number('change')} END
          || '%)<br />' AS line
        FROM (
          SELECT gemeinde, date, {half_even('x', 0)} AS inc_today,
                 {half_even('(x - before) / nullif(before, 0) * 100', 2)} AS change, last
          FROM (SELECT gemeinde, date, x, last, lag(x) OVER (PARTITION BY gemeinde ORDER BY date) AS before
                FROM (SELECT gemeinde, date, Incidence_7d_per_100k AS x,
                             max(date) OVER (PARTITION BY gemeinde) AS last FROM case_history)
                WHERE date >= last - INTERVAL 1 DAY))
        WHERE date = last"""
)
def incidence_today_and_change(t: Tables) -> DataFrame:
    return views.incidence_today_and_change(s.case_history(t))


@query(
    """SELECT gemeinde, date, cumCases, cumDeaths, FallNeu, Incidence_7d_per_100k, faelle_covid_aktuell,
              faelle_covid_aktuell_beatmet
       FROM (SELECT IdLandkreis AS gemeinde, Refdatum AS date, CAST(sum(sum(cases)) OVER w AS BIGINT) AS cumCases,
                    CAST(sum(sum(deaths)) OVER w AS BIGINT) AS cumDeaths
             FROM age_daily GROUP BY 1, 2 WINDOW w AS (PARTITION BY IdLandkreis ORDER BY Refdatum))
       FULL JOIN (SELECT gemeinde, date, FallNeu, Incidence_7d_per_100k FROM case_history) USING (gemeinde, date)
       FULL JOIN (SELECT gemeinde, date, faelle_covid_aktuell, faelle_covid_aktuell_beatmet FROM icu_clean)
         USING (gemeinde, date)"""
)
def county_case_curve(t: Tables) -> DataFrame:
    return views.county_case_curve(s.case_age(t), s.case_history(t), s.icu_clean(t))


@query("SELECT IdLandkreis, Refdatum, Altersgruppe, cumCases, cumDeaths FROM case_age")
def county_age_curve(t: Tables) -> DataFrame:
    return views.county_age_curve(s.case_age(t))


@query(
    f"""SELECT date, a AS sum_area, CAST(p AS BIGINT) AS sum_pop, st AS sum_standorte, f AS sum_free_beds, b AS sum_occup_beds,
          'Deutschland<br />Fläche: ' || {sql_number('a')} || 'km²<br />Einwohner: ' || {sql_number('p')}
          || '<br />Standorte: ' || {sql_number('st')} || '<br />Betten: ' || {sql_number('f')} || '/'
          || {sql_number('(f + b)')} AS card
        FROM (SELECT date, CASE WHEN count(area) = count(*) THEN sum(area) END AS a,
                     CASE WHEN count(pop_all) = count(*) THEN sum(pop_all) END AS p,
                     sum(anzahl_standorte) AS st, sum(betten_frei) AS f, sum(betten_belegt) AS b
              FROM icu_metrics GROUP BY date)
        WHERE date = (SELECT max(date) FROM icu_metrics)"""
)
def germany_stats(t: Tables) -> DataFrame:
    return views.germany_stats(s.icu_metrics(t))


@query(
    """SELECT date, bundesland, c AS sum_faelle_covid_aktuell,
              CASE bundesland WHEN 1 THEN 'Schleswig-Holstein' WHEN 2 THEN 'Hamburg'
                   WHEN 3 THEN 'Niedersachsen' WHEN 4 THEN 'Bremen' END AS state_name
       FROM (SELECT date, bundesland,
                    CASE WHEN count(faelle_covid_aktuell) = count(*) THEN sum(faelle_covid_aktuell) END AS c
             FROM icu_clean WHERE bundesland IS NOT NULL GROUP BY 1, 2)"""
)
def state_curves(t: Tables) -> DataFrame:
    return views.state_curves(s.icu_clean(t))


@query(
    f"""SELECT date, {half_even('c / nullif(b, 0) * 100', 1)} AS pct_covid,
               {half_even('b / nullif(f + b, 0) * 100', 1)} AS auslastung
        FROM (SELECT date, sum(betten_frei) AS f, sum(betten_belegt) AS b,
                     CASE WHEN count(faelle_covid_aktuell) = count(*) THEN sum(faelle_covid_aktuell) END AS c
              FROM icu_clean GROUP BY date)"""
)
def germany_occupancy(t: Tables) -> DataFrame:
    return views.germany_occupancy(s.icu_clean(t))


@query(
    """SELECT gemeinde, date, pct_covid, auslastung, parameter, value
       FROM (SELECT gemeinde, date, pct_covid, auslastung, betten_frei, betten_belegt FROM icu_metrics)
       UNPIVOT INCLUDE NULLS (value FOR parameter IN (betten_frei, betten_belegt))"""
)
def county_occupancy(t: Tables) -> DataFrame:
    return views.county_occupancy(s.icu_metrics(t))


@query("SELECT gemeinde, date, faelle_covid_aktuell, faelle_covid_aktuell_beatmet FROM icu_metrics")
def county_beds(t: Tables) -> DataFrame:
    return views.county_beds(s.icu_metrics(t))


@query("SELECT gemeinde, date, covid_per_100k, covid_per_100k_intubated FROM icu_metrics")
def county_per_100k(t: Tables) -> DataFrame:
    return views.county_per_100k(s.icu_metrics(t))


@query(
    f"""SELECT gemeinde, name, false AS is_missing, pct_covid AS z,
          '<b>' || coalesce(name, 'NA') || '</b><br />Kliniken: ' || {sql_number('anzahl_standorte')}
          || '<br />Betten(frei): ' || {sql_number('betten_frei')} || '<br />Betten(belegt): '
          || {sql_number('betten_belegt')} || '<br />Auslastung(%): ' || {sql_number('auslastung')}
          || '<br />Anteil COVID(%): ' || {sql_number('pct_covid')} AS hover
        FROM {_ICU_TODAY}
        UNION ALL
        SELECT g, n, true, 0.0::DOUBLE, '<b>' || n || '</b><br />Kliniken: 0' FROM (VALUES
          ('07338', 'Rhein-Pfalz-Kreis'), ('09374', 'Landkreis neustadt an der Waldnaab'),
          ('09473', 'Landkreis Coburg'), ('09573', 'Landkreis Fürth')) m(g, n)"""
)
def map_today(t: Tables) -> DataFrame:
    return views.map_today(s.icu_metrics(t), s.report_days(t))
