"""The two nightly jobs, from raw feed files to stored tables. Run ``load_cases`` before ``load_icu``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wardwatch.forecast.evaluate import wide_forecast
from wardwatch.forecast.run import NIGHTLY_MODELS, create_forecasts, forecast_with_context
from wardwatch.operators.aggregates import distinct_first, national_total_row
from wardwatch.operators.joins import sites_with_sections
from wardwatch.plans import nightly, views
from wardwatch.session import settle
from wardwatch.sources import feeds, geo, sites as st
from wardwatch.sources.reports import clean_reports, latest_reports, read_daily_reports
from wardwatch.sources.tables import read_table, write_table

VARIABLES = ["sum_covid", "sum_intub"]


@dataclass
class Feeds:
    """Where the raw files lie."""

    county: str
    history: str
    cases: str
    vaccination: str
    nowcast: str
    reports: str
    features: str | None = None
    case_schema: str = feeds.CASE_SCHEMA


def _county(spark: SparkSession, paths: Feeds):
    return feeds.load_county_dim(feeds.read_typed_csv(spark, paths.county, feeds.COUNTY_SCHEMA))


def load_cases(spark: SparkSession, paths: Feeds, root: str) -> None:
    """History, cases by age, vaccinations and nowcast."""
    nation = national_total_row(_county(spark, paths))
    history = nightly.case_history(feeds.clean_history(feeds.read_paged_json(spark, paths.history)), nation)
    ages = nightly.case_age(feeds.clean_case_rows(feeds.read_typed_csv(spark, paths.cases, paths.case_schema)))
    doses = feeds.clean_vaccination(feeds.read_typed_csv(spark, paths.vaccination, feeds.VACCINATION_SCHEMA))
    nightly.store_cases(
        root,
        history,
        ages,
        nightly.vaccination(doses),
        feeds.read_decimal_comma_csv(spark, paths.nowcast),
    )


def load_icu(spark: SparkSession, paths: Feeds, root: str, model_ids: list[int] = NIGHTLY_MODELS, origins: int = 0) -> None:
    """ICU table, county names, forecast with its regressors and its accuracy, and the enriched map.

    ``origins``: see ``create_forecasts``.
    """
    cleaned = clean_reports(latest_reports(read_daily_reports(spark, paths.reports)))
    nightly.store_icu(root, nightly.icu_daily(cleaned, _county(spark, paths), read_table(spark, root, "case_history")))
    stored = read_table(spark, root, "icu_daily")
    store_forecast(nightly.forecast_input(stored), root, "forecast", model_ids, origins)
    if paths.features is not None:
        enriched = geo.enrich_features(geo.read_features(spark, paths.features), stored)
        geo.write_geojson(geo.feature_json(enriched), f"{root}/map_geojson")


def store_forecast(history: DataFrame, root: str, name: str, model_ids: list[int] = NIGHTLY_MODELS, origins: int = 0) -> None:
    """Write a forecast next to the regressors of its dates, and its accuracy."""
    history = settle(history)
    result = create_forecasts(history, VARIABLES, model_ids, origins=origins)
    wide = wide_forecast(result.forecast, VARIABLES)
    write_table(forecast_with_context(wide, history), root, name)
    write_table(result.accuracy, root, f"{name}_accuracy")


def load_county_forecasts(spark: SparkSession, root: str, model_ids: list[int] = NIGHTLY_MODELS) -> None:
    """The forecast of every county, from the stored ICU table."""
    store_forecast(nightly.county_forecast_input(read_table(spark, root, "icu_daily")), root, "county_forecast", model_ids)


ZIP_SCHEMA = "zipcode string, community_code string, line long"


def load_hospitals(spark: SparkSession, sites: str, zips: str, root: str, zip_schema: str = ZIP_SCHEMA, sections: str | None = None) -> None:
    """Postcodes, hospital sites with their county and availability, their reporting units and, if given, sections.

    ``sites`` and ``sections`` are JSON files with one site a line, ``zips`` CSV files whose first row of a postcode counts.
    """
    rows = feeds.load_zip_dim(spark, zips, zip_schema)
    write_table(distinct_first(rows, "zipcode", ["line"]), root, "zips")
    raw = st.read_sites(spark, sites)
    located = views.located_sites(st.flatten_sites(raw), read_table(spark, root, "zips").select("zipcode", "community_code"))
    write_table(located, root, "hospital_sites")
    write_table(st.explode_units(raw), root, "hospital_units")
    if sections is not None:
        store_sections(st.read_sections(spark, sections), read_table(spark, root, "hospital_sites"), root)


def store_sections(sections: DataFrame, sites: DataFrame, root: str) -> None:
    """Write the sections of the located sites with the county of their site."""
    write_table(sites_with_sections(sites, sections), root, "hospital_sections")
