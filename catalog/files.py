"""Sources and sinks: the feeds are derived from the given tables, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import standins as s
from catalog.base import Tables, query
from wardwatch.operators import aggregates
from wardwatch.operators.reshape import bind_rows
from wardwatch.session import scratch_path
from wardwatch.sources import feeds, geo, reports, sites as st, tables
from wardwatch.sources.reports import REPORT_MEASURES
from wardwatch.streaming.ingest import ingest_reports_stream

HEADER_CHANGE = "1998-01-01"


def report_texts(raw: DataFrame, suffix: str = "''") -> list[DataFrame]:
    """Report rows as text in the two headers of the feed: up to ``HEADER_CHANGE`` and from then on.

    ``suffix`` is the SQL text of what follows the time in the file name.
    """
    name = F.concat(F.lit("divi-intensivregister-"), F.col("date").cast("string"), F.lit("-12-15"),
                    F.expr(suffix), F.lit(".csv"))
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ["bundesland", *REPORT_MEASURES]}
    rows = raw.withColumns(text).withColumn("report", name)
    figures = [m for m in REPORT_MEASURES if m != "faelle_covid_aktuell_beatmet"]
    ventilated = F.col("faelle_covid_aktuell_beatmet")
    old = rows.filter(F.col("date") < HEADER_CHANGE).select(
        "report", F.col("gemeindeschluessel").alias("kreis"), "bundesland", *figures,
        ventilated.alias("faelle_covid_aktuell_invasiv_beatmet"), "daten_stand",
    )
    # Old reports carry the padded key already: only the newer column is padded on reading.
    old = old.withColumn("kreis", s.pad_report_key("kreis"))
    new = rows.filter(F.col("date") >= HEADER_CHANGE).select(
        "report", F.lit("1").alias("X"), "daten_stand", "gemeindeschluessel", "bundesland",
        ventilated.alias("faelle_covid_aktuell_beatmet"), *reversed(figures),
    )
    return [old, new]


def write_reports(raw: DataFrame, path: str, suffix: str = "''") -> None:
    """Thousands of folders with one small file each: a few listing tasks beat one task per folder."""
    raw.sparkSession.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "32")
    for part in report_texts(raw, suffix):
        reports.write_raw_reports(part, path, mode="append")


@query("SELECT * FROM icu_clean")
def daily_reports(t: Tables) -> DataFrame:
    """Raw daily files under two headers: written, read by name, cleaned."""
    path = scratch_path(t.spark, "reports")
    write_reports(s.icu_reports(t), path)
    return reports.clean_reports(reports.read_daily_reports(t.spark, path))


@query("SELECT * FROM icu_clean")
def report_stream(t: Tables) -> DataFrame:
    """The same files in two drops, with re-uploads that correct wrong first uploads."""
    incoming, store = scratch_path(t.spark, "incoming"), scratch_path(t.spark, "store")
    raw = s.icu_reports(t)
    wrong, even = F.unix_date("date") % 10 == 0, F.unix_date("date") % 2 == 0
    spoiled = F.when(wrong, F.col("betten_frei") + 1000).otherwise(F.col("betten_frei"))
    write_reports(raw.filter(even).withColumn("betten_frei", spoiled), incoming)
    ingest_reports_stream(t.spark, incoming, store).awaitTermination()
    write_reports(raw.filter(~even | wrong), incoming, suffix="CASE WHEN unix_date(date) % 10 = 0 THEN '-2' ELSE '' END")
    ingest_reports_stream(t.spark, incoming, store).awaitTermination()
    return tables.read_table(t.spark, store, "icu_reports")


@query("SELECT IdBundesland, IdLandkreis, CAST(Refdatum AS TIMESTAMP) AS Refdatum, Altersgruppe, cases, deaths FROM age_daily")
def typed_csv(t: Tables) -> DataFrame:
    """The case feed as CSV with declared types, cleaned and summed."""
    path = scratch_path(t.spark, "cases")
    stamp = F.date_format("date", "yyyy/MM/dd' 00:00:00+00'")
    raw = s.case_events(t).select(
        F.col("state").alias("IdBundesland"),
        s.case_key(F.col("nation"), F.col("number")).alias("IdLandkreis"),
        F.col("age").alias("Altersgruppe"),
        F.lit(1).alias("AnzahlFall"),
        (F.col("status") == "F").cast("int").alias("AnzahlTodesfall"),
        stamp.alias("Meldedatum"),
        stamp.alias("Refdatum"),
        F.date_format("date", "dd.MM.yyyy', 00:00 Uhr'").alias("Datenstand"),
    )
    raw.write.option("header", True).csv(path)
    rows = feeds.clean_case_rows(feeds.read_typed_csv(t.spark, path, feeds.CASE_SCHEMA))
    rows = rows.withColumn("Refdatum", F.col("Refdatum").cast("timestamp_ntz"))
    return aggregates.cases_by_age(rows)


@query(
    """SELECT date AS Date, n * 1.5::DOUBLE AS PredictedNew, n * 1.25::DOUBLE AS PredictedNew_Low, n * 1.75::DOUBLE AS PredictedNew_High,
         n * 0.5::DOUBLE AS PredictedNew_Interpolated, n * 0.25::DOUBLE AS PredictedNew_Interpolated_Low,
         n * 0.75::DOUBLE AS PredictedNew_Interpolated_High, n / 4::DOUBLE AS R7d, n / 8::DOUBLE AS R7d_Low, n / 2::DOUBLE AS R7d_High
       FROM (SELECT date, count(*) AS n FROM case_events GROUP BY 1)"""
)
def decimal_comma_csv(t: Tables) -> DataFrame:
    """A nowcast file with decimal commas; rows without a date are dropped."""
    path = scratch_path(t.spark, "nowcast")
    n = F.col("n").cast("double")
    days = s.case_events(t).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    factors = [1.5, 1.25, 1.75, 0.5, 0.25, 0.75, 0.25, 0.125, 0.5]
    numbers = [F.translate((n * f).cast("string"), ".", ",").alias(c) for f, c in zip(factors, feeds.NOWCAST_COLUMNS[1:])]
    dated = days.select(F.col("date").cast("string").alias("Datum"), *numbers)
    bind_rows(dated, dated.withColumn("Datum", F.lit("total"))).write.option("header", True).csv(path)
    return feeds.read_decimal_comma_csv(t.spark, path)


@query("SELECT gemeinde, date, BundeslandId, AnzFallNeu, AnzFallVortag, AnzFallErkrankung, AnzFallMeldung, KumFall FROM history_daily")
def paged_json(t: Tables) -> DataFrame:
    """History pages of one county and year each: written, read, cleaned."""
    path = scratch_path(t.spark, "pages")
    rows = s.history_attributes(t)
    year = F.year(F.to_date(F.timestamp_millis("Datum"))).cast("string")
    page = F.concat_ws("-", "AdmUnitId", year).alias("page")
    feature = F.struct(F.struct(*rows.columns).alias("attributes"))
    # A page has at most one row per day of its year.
    pages = rows.groupBy(page).agg(F.collect_list(feature).alias("features"))
    pages.select("page", F.to_json(F.struct("features")).alias("value")).write.partitionBy("page").text(path)
    return feeds.clean_history(feeds.read_paged_json(t.spark, path))


@query("SELECT * FROM sites_flat")
def site_files(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "sites")
    s.sites(t).write.json(path)
    return st.flatten_sites(st.read_sites(t.spark, path))


@query("SELECT zipcode, community_code, line FROM zips")
def zip_file(t: Tables) -> DataFrame:
    """Postcodes from a typed CSV, first row of each kept."""
    path = scratch_path(t.spark, "zips")
    s.zip_rows(t).write.option("header", True).csv(path)
    rows = feeds.load_zip_dim(t.spark, path, "zipcode string, community_code string, line long")
    return aggregates.distinct_first(rows, "zipcode", ["line"])


@query("SELECT gemeinde, date, FallNeu, Fall7d, Incidence_7d_per_100k FROM case_history WHERE date >= DATE '1998-01-01'")
def stored_table(t: Tables) -> DataFrame:
    """The history table written by month and read from one month on."""
    root = scratch_path(t.spark, "tables")
    columns = ["gemeinde", "date", "FallNeu", "Fall7d", "Incidence_7d_per_100k"]
    tables.write_table(s.case_history(t).select(*columns), root, "case_history", month_of="date")
    return tables.read_table(t.spark, root, "case_history", since="1998-01").select(*columns)


@query("SELECT gemeinde, date, FallNeu + CAST(year(date) % 4 = 1 AS BIGINT) AS FallNeu, Incidence_7d_per_100k FROM case_history")
def replaced_months(t: Tables) -> DataFrame:
    """The history table, then the months of some years again with other numbers; the other months stay as they were."""
    root = scratch_path(t.spark, "tables")
    history = s.case_history(t).select("gemeinde", "date", "FallNeu", "Incidence_7d_per_100k")
    tables.write_table(history, root, "case_history", month_of="date")
    again = tables.read_table(t.spark, root, "case_history").where(F.year("date") % 4 == 1).withColumn("FallNeu", F.col("FallNeu") + 1)
    tables.write_table(again, root, "case_history", month_of="date", changed_only=True)
    return tables.read_table(t.spark, root, "case_history")


@query("SELECT gemeinde, date, betten_frei, betten_belegt FROM icu_clean WHERE date = (SELECT max(date) FROM icu_clean)")
def newest_day(t: Tables) -> DataFrame:
    """The rows of the last date of the stored ICU table, which is found in the files' footers."""
    root = scratch_path(t.spark, "tables")
    tables.write_table(s.icu_clean(t).select("gemeinde", "date", "betten_frei", "betten_belegt"), root, "icu_daily", month_of="date")
    return tables.newest_day(t.spark, root, "icu_daily")


@query(
    """SELECT position, RS, betten_frei, betten_belegt, faelle_covid_aktuell FROM features
       LEFT JOIN (SELECT * FROM icu_clean WHERE date = (SELECT max(date) FROM icu_clean)) ON gemeinde = RS"""
)
def geojson(t: Tables) -> DataFrame:
    """The enriched feature collection, written and its feature lines read back."""
    path = scratch_path(t.spark, "map")
    geo.write_geojson(geo.feature_json(geo.enrich_features(s.features(t), s.icu_clean(t))), path)
    lines = t.spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("value"))
    line = F.col("value")
    return lines.filter(line.startswith('{"type":"Feature",')).select(
        (F.get_json_object(line, "$.properties.EWZ").cast("int") - 1).alias("position"),
        F.get_json_object(line, "$.properties.RS").alias("RS"),
        *[
            F.get_json_object(line, f"$.properties.{m}").cast("double").alias(m)
            for m in ("betten_frei", "betten_belegt", "faelle_covid_aktuell")
        ],
    )
