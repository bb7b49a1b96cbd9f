"""Report views over the stored tables. ``county=None`` gives the rows of all counties.

Fixed values: the German labels on cards and maps, which must read as users know them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwatch.functions.nulls import percent, round_even
from wardwatch.functions.text import format_de, labelled, or_na, plain_number, signed, text_block
from wardwatch.operators.aggregates import (
    county_daily,
    dose_totals,
    exact_median,
    map_viewport,
    national_icu,
    national_occupancy,
    national_stats,
    state_icu,
)
from wardwatch.operators.clean import COUNTY_OF_ZIP, override_by_key, relabel_status, state_name
from wardwatch.operators.filters import for_counties, last_n_days, latest_global, latest_per_county, national_only
from wardwatch.operators.joins import join_population, join_zip, sites_with_sections
from wardwatch.operators.reshape import add_missing_counties, pivot_beds_long, pivot_dose_wide
from wardwatch.operators.windows import add_running_totals, pct_change, per_series
from wardwatch.sources.sites import STATUS_COLUMNS, section_details


def county_stats(
    icu: DataFrame, history: DataFrame, county: str | None = None, icu_days: DataFrame | None = None, history_days: DataFrame | None = None
) -> DataFrame:
    """The stats card of a county: newest report and newest case figures as text.

    ``icu_days`` and ``history_days`` may have the same last dates and be cheaper to read (see ``latest_global``).
    """
    beds = for_counties(latest_global(icu, dates=icu_days), county)
    cases = for_counties(latest_global(history, dates=history_days), county).select(
        "gemeinde",
        F.col("Incidence_7d_per_100k").alias("incidence"),
        F.col("date").alias("case_date"),
    )
    total = F.col("betten_frei") + F.col("betten_belegt")
    card = text_block(
        labelled("Gemeinde: ", or_na("name")),
        labelled("Fläche: ", F.coalesce(format_de("area", 2), F.lit("NA")), F.lit("km²")),
        labelled("Einwohner: ", F.coalesce(format_de("pop_all"), F.lit("NA"))),
        labelled("Standorte: ", plain_number("anzahl_standorte")),
        labelled("Betten(frei/gesamt): ", plain_number("betten_frei"), F.lit("/"), plain_number(total)),
        labelled("7-Tage Inzidenz: ", plain_number(round_even("incidence")), F.lit("Fälle/100.000 Einwohner")),
        labelled("Aktualisiert(DIVI): ", or_na("daten_stand")),
        labelled("Aktualisiert(RKI): ", or_na("case_date")),
    )
    return beds.join(cases, "gemeinde", "left").select("gemeinde", card.alias("card"))


def incidence_today_and_change(history: DataFrame, county: str | None = None) -> DataFrame:
    """Newest incidence of each county and its change within one day, as numbers and as text."""
    rows = for_counties(history, county).select("gemeinde", "date", "Incidence_7d_per_100k")
    change = pct_change("Incidence_7d_per_100k", per_series(["gemeinde"], "date"))
    recent = last_n_days(rows, 1).withColumn("change", round_even(change, 2))
    today = latest_per_county(recent).withColumn("inc_today", round_even("Incidence_7d_per_100k"))
    line = F.concat(
        F.lit("Inzidenz heute: "), plain_number("inc_today"), F.lit("("), signed_or_na("change"), F.lit("%)<br />")
    )
    return today.select("gemeinde", "date", "inc_today", "change", line.alias("line"))


def signed_or_na(column: str):
    return F.when(F.col(column).isNull(), F.lit("NA")).otherwise(signed(column))


def county_case_curve(
    case_age: DataFrame, history: DataFrame, icu: DataFrame, county: str | None = None
) -> DataFrame:
    """Running cases and deaths, new cases, incidence and patients of a county on one date axis."""
    daily = county_daily(for_counties(case_age, county, "IdLandkreis"))
    totals = add_running_totals(daily, ["IdLandkreis"], "Refdatum", {"cases": "cumCases", "deaths": "cumDeaths"})
    totals = totals.select(
        F.col("IdLandkreis").alias("gemeinde"), F.to_date("Refdatum").alias("date"), "cumCases", "cumDeaths"
    )
    new = for_counties(history, county).select("gemeinde", "date", "FallNeu", "Incidence_7d_per_100k")
    beds = for_counties(icu, county).select(
        "gemeinde", "date", "faelle_covid_aktuell", "faelle_covid_aktuell_beatmet"
    )
    keys = ["gemeinde", "date"]
    return totals.join(new, keys, "full").join(beds, keys, "full")


def county_age_curve(case_age: DataFrame, county: str | None = None) -> DataFrame:
    return for_counties(case_age, county, "IdLandkreis").select(
        "IdLandkreis", "Refdatum", "Altersgruppe", "cumCases", "cumDeaths"
    )


def county_vaccinated_pct(vaccination: DataFrame, county_dim: DataFrame, county: str | None = None) -> DataFrame:
    """Vaccinated people in percent of the population per dose and day."""
    totals = dose_totals(for_counties(vaccination, county, "IdLandkreis"))
    joined = join_population(totals, county_dim.select("key", "pop_all"), "IdLandkreis")
    return joined.select("IdLandkreis", "vcCount", "date", "cum_count",
                         percent("cum_count", "pop_all").alias("pct_vac"))


def county_vaccination(vaccination: DataFrame, county: str | None = None) -> DataFrame:
    """Counts per age group and day with one column per dose."""
    return pivot_dose_wide(for_counties(vaccination, county, "IdLandkreis"))


def germany_stats(icu: DataFrame) -> DataFrame:
    """The stats card of the nation on the newest date."""
    latest = latest_global(national_stats(icu))
    beds = F.col("sum_free_beds") + F.col("sum_occup_beds")
    card = text_block(
        F.lit("Deutschland"),
        labelled("Fläche: ", plain_number("sum_area"), F.lit("km²")),
        labelled("Einwohner: ", plain_number("sum_pop")),
        labelled("Standorte: ", plain_number("sum_standorte")),
        labelled("Betten: ", plain_number("sum_free_beds"), F.lit("/"), plain_number(beds)),
    )
    return latest.withColumn("card", card)


def germany_icu_with_forecast(icu: DataFrame, history: DataFrame, forecast: DataFrame) -> DataFrame:
    """National patients, new cases and the forecast with its bands on one date axis.

    ``forecast`` has one row per date with ``value_``, ``conf_lo_`` and ``conf_hi_`` columns.
    """
    new = national_only(history).groupBy("date").agg(F.sum("AnzFallErkrankung").alias("AnzFallErkrankung"))
    return national_icu(icu).join(new, "date", "full").join(forecast, "date", "full")


def state_curves(icu: DataFrame) -> DataFrame:
    """Patients per state and day under the state's name."""
    return state_icu(icu).withColumn("state_name", state_name("bundesland"))


def germany_occupancy(icu: DataFrame) -> DataFrame:
    return national_occupancy(icu).select("date", "pct_covid", "auslastung")


def county_occupancy(icu: DataFrame, county: str | None = None) -> DataFrame:
    """Bed counts in long form next to the shares."""
    rows = for_counties(icu, county).select(
        "gemeinde", "date", "pct_covid", "auslastung", "betten_frei", "betten_belegt"
    )
    return pivot_beds_long(rows)


def county_beds(icu: DataFrame, county: str | None = None) -> DataFrame:
    return for_counties(icu, county).select(
        "gemeinde", "date", "faelle_covid_aktuell", "faelle_covid_aktuell_beatmet"
    )


def county_per_100k(icu: DataFrame, county: str | None = None) -> DataFrame:
    return for_counties(icu, county).select("gemeinde", "date", "covid_per_100k", "covid_per_100k_intubated")


def map_today(icu: DataFrame, icu_days: DataFrame | None = None) -> DataFrame:
    """Newest figures per county with hover text, and the counties without intensive care."""
    day = add_missing_counties(
        latest_global(icu, dates=icu_days).select(
            "gemeinde", "bundesland", "name", "type", "anzahl_standorte", "anzahl_meldebereiche",
            "betten_frei", "betten_belegt", "auslastung", "pct_covid",
        )
    )
    head = [
        labelled("<b>", or_na("name"), F.lit("</b>")),
        labelled("Kliniken: ", plain_number("anzahl_standorte")),
    ]
    figures = [
        labelled("Betten(frei): ", plain_number("betten_frei")),
        labelled("Betten(belegt): ", plain_number("betten_belegt")),
        labelled("Auslastung(%): ", plain_number("auslastung")),
        labelled("Anteil COVID(%): ", plain_number("pct_covid")),
    ]
    hover = F.when(F.col("is_missing"), text_block(*head)).otherwise(text_block(*head, *figures))
    shade = F.when(F.col("is_missing"), F.lit(0.0)).otherwise(F.col("pct_covid"))
    return day.select("gemeinde", "name", "is_missing", shade.alias("z"), hover.alias("hover"))


def located_sites(sites: DataFrame, zips: DataFrame) -> DataFrame:
    """Sites with their county and labelled availability."""
    joined = override_by_key(join_zip(sites, zips), "plz", "community_code", COUNTY_OF_ZIP)
    return relabel_status(joined, STATUS_COLUMNS)


def hospital_map(located: DataFrame, status: str = STATUS_COLUMNS[1], county: str | None = None) -> DataFrame:
    """Markers of sites with hover text, coloured by the chosen availability."""
    hover = text_block(
        labelled("<b>", or_na("bezeichnung"), F.lit("</b>")),
        labelled("Address: ", or_na("strasse"), F.lit(" "), or_na("hausnummer"), F.lit(", "),
                 or_na("plz"), F.lit(" "), or_na("ort")),
        labelled("Low Care: ", or_na("maxBettenStatusEinschaetzungLowCare")),
        labelled("High Care: ", or_na("maxBettenStatusEinschaetzungHighCare")),
        labelled("ECMO: ", or_na("maxBettenStatusEinschaetzungEcmo")),
    )
    return for_counties(located, county, "community_code").select(
        "id", "community_code", "latitude", "longitude",
        F.col(status).alias("color"), F.col(f"{status}_rank").alias("color_rank"), hover.alias("hover"),
    )


def county_viewport(located: DataFrame, county: str | None = None) -> DataFrame:
    """Where each county's site map is centred and how far it is zoomed."""
    return map_viewport(for_counties(located, county, "community_code"), "community_code")


def map_centre(sites: DataFrame) -> DataFrame:
    """Centre of the national site map: exact medians."""
    longitude, latitude = exact_median(sites, "longitude"), exact_median(sites, "latitude")
    return longitude.select(
        F.col("longitude").alias("center_lon"), latitude.scalar().alias("center_lat")
    )


def hospital_sections(located: DataFrame, sections: DataFrame, county: str | None = None) -> DataFrame:
    """Reporting sections of the sites, ready for display."""
    stacked = sites_with_sections(for_counties(located, county, "community_code"), sections)
    return section_details(stacked, "id", "community_code")
