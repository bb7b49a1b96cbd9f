"""Hospital sites, sections, postcodes, pages and map features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import standins as s
from catalog.base import Tables, query
from wardwatch.operators import aggregates, clean, joins
from wardwatch.plans import jobs, views
from wardwatch.session import scratch_path
from wardwatch.sources import geo, pages as web, reports, sites as st, tables
from wardwatch.sources.reports import REPORT_MEASURES


def flat(t: Tables) -> DataFrame:
    return st.flatten_sites(s.sites(t))


def located(t: Tables) -> DataFrame:
    return views.located_sites(flat(t), s.zips(t))


@query("SELECT * FROM sites_flat")
def flatten_sites(t: Tables) -> DataFrame:
    """Sites parsed from JSON text and flattened; odd sites arrive wrapped in a ``data`` list."""
    nested = F.struct(*s.sites(t).columns)
    text = s.sites(t).select(
        F.when(F.col("krankenhausStandort.id").cast("long") % 2 == 0, F.to_json(nested))
        .otherwise(F.concat(F.lit('{"data":['), F.to_json(nested), F.lit("]}"))).alias("value")
    )
    return st.flatten_sites(st.parse_sites(text))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS id,
         CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey AS VARCHAR) || '-1' END AS unitId,
         CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END END AS ardsNetwork,
         CASE WHEN s_suppkey % 3 <> 0 THEN 'Intensiv' END AS unitName
       FROM supplier"""
)
def explode_units(t: Tables) -> DataFrame:
    return st.explode_units(s.sites(t))


@query("SELECT zipcode, community_code, line FROM zips")
def distinct_first(t: Tables) -> DataFrame:
    return aggregates.distinct_first(s.zip_rows(t), "zipcode", ["line"])


@query("SELECT id, plz, zips.community_code FROM sites_flat LEFT JOIN zips ON zipcode = plz")
def join_zip(t: Tables) -> DataFrame:
    return joins.join_zip(flat(t), s.zips(t)).select("id", "plz", "community_code")


@query("SELECT * FROM sites_located")
def located_sites(t: Tables) -> DataFrame:
    """Postcode join, counties set by hand, relabelled availability."""
    return located(t)


@query(
    """SELECT plz, CASE plz WHEN '19049' THEN '13004' WHEN '59870' THEN '05958' ELSE bundesland END AS code
       FROM sites_flat"""
)
def override_by_key(t: Tables) -> DataFrame:
    df = flat(t).select("plz", F.col("bundesland").alias("code"))
    return clean.override_by_key(df, "plz", "code", clean.COUNTY_OF_ZIP)


@query(
    """SELECT code, CASE code WHEN 'VERFUEGBAR' THEN 'Verfügbar' WHEN 'BEGRENZT' THEN 'Begrenzt'
                WHEN 'NICHT_VERFUEGBAR' THEN 'Nicht verfügbar' WHEN 'KEINE_ANGABE' THEN 'Keine Angabe' END AS status,
              CASE code WHEN 'VERFUEGBAR' THEN 1 WHEN 'BEGRENZT' THEN 2 WHEN 'NICHT_VERFUEGBAR' THEN 3
                WHEN 'KEINE_ANGABE' THEN 4 END AS status_rank, CAST(count(*) AS BIGINT) AS sites
       FROM (SELECT maxBettenStatusEinschaetzungLowCare AS code FROM sites_flat) GROUP BY 1"""
)
def relabel_status(t: Tables) -> DataFrame:
    code = F.col("maxBettenStatusEinschaetzungLowCare")
    counts = flat(t).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("sites"))
    return clean.relabel_status(counts.withColumn("status", F.col("code")), ["status"])


@query(
    """SELECT community_code, (max(longitude) + min(longitude)) / 2 AS center_lon,
              (max(latitude) + min(latitude)) / 2 AS center_lat,
              greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)) AS extent,
              CASE WHEN greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)) > 0
                   THEN -1.35::DOUBLE * ln(greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)))
                        + 8 END AS zoom
       FROM sites_located GROUP BY 1"""
)
def map_viewport(t: Tables) -> DataFrame:
    return views.county_viewport(located(t))


@query("SELECT median(longitude) AS center_lon, median(latitude) AS center_lat FROM sites_flat")
def map_centre(t: Tables) -> DataFrame:
    return views.map_centre(flat(t))


@query("SELECT median(o_totalprice) AS o_totalprice FROM orders")
def exact_median(t: Tables) -> DataFrame:
    return aggregates.exact_median(t.orders, "o_totalprice")


_SQL_SECTION = """SELECT CAST(conv_id AS VARCHAR) AS id, l.community_code, role || ' ' || CAST(turn AS VARCHAR) AS Bereich,
         '2021-05-01' AS "Letzte Meldung", role AS Behandlungsschwerpunkt, CAST(NULL AS VARCHAR) AS Spezialisierung,
         role || ', ' || CAST(turn AS VARCHAR) AS Ansprechpartner, replace(text, ' ', ', ') AS tags
       FROM conversations JOIN sites_located l ON l.id = CAST(conv_id AS VARCHAR)"""


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS id, l.community_code, role AS schwerpunkt, text
       FROM conversations JOIN sites_located l ON l.id = CAST(conv_id AS VARCHAR)"""
)
def sites_with_sections(t: Tables) -> DataFrame:
    stacked = joins.sites_with_sections(located(t), s.sections(t))
    return stacked.select(
        "id", "community_code", F.col("behandlungsschwerpunktL1").alias("schwerpunkt"),
        F.array_join("tags", " ").alias("text"),
    )


@query(_SQL_SECTION)
def hospital_sections(t: Tables) -> DataFrame:
    return views.hospital_sections(located(t), s.sections(t))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS id, l.community_code, role || ' ' || CAST(turn AS VARCHAR) AS bezeichnung, role AS schwerpunkt, text
       FROM conversations JOIN sites_located l ON l.id = CAST(conv_id AS VARCHAR)"""
)
def stored_sections(t: Tables) -> DataFrame:
    """Sections as files of one site a line, stored next to the county of their site and read back."""
    root = scratch_path(t.spark, "hospitals")
    listed = s.sections(t).groupBy("id").agg(F.collect_list(F.struct(*st.SECTION_HEADINGS, "tags")).alias("sections"))
    listed.write.json(f"{root}/sections")
    jobs.store_sections(st.read_sections(t.spark, f"{root}/sections"), located(t), root)
    return tables.read_table(t.spark, root, "hospital_sections").select(
        "id", "community_code", "bezeichnung", F.col("behandlungsschwerpunktL1").alias("schwerpunkt"), F.array_join("tags", " ").alias("text")
    )


_SQL_PLACE = """'<b>' || bezeichnung || '</b><br />Address: ' || strasse || ' ' || hausnummer || ', ' || plz || ' ' || ort"""


@query(
    f"""SELECT id, community_code, latitude, longitude, maxBettenStatusEinschaetzungHighCare AS color,
         maxBettenStatusEinschaetzungHighCare_rank AS color_rank,
         {_SQL_PLACE} || '<br />Low Care: ' || coalesce(maxBettenStatusEinschaetzungLowCare, 'NA')
           || '<br />High Care: ' || coalesce(maxBettenStatusEinschaetzungHighCare, 'NA')
           || '<br />ECMO: ' || coalesce(maxBettenStatusEinschaetzungEcmo, 'NA') AS hover
       FROM sites_located"""
)
def hospital_map(t: Tables) -> DataFrame:
    return views.hospital_map(located(t))


# --- pages --------------------------------------------------------------------------------------

_SQL_LINKS = r"""regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)"""


@query(
    f"""SELECT page_id, CAST(position AS INTEGER) AS position,
              CASE WHEN starts_with(link, '/') THEN 'https://archive.example.org' || link ELSE link END AS link
       FROM (SELECT page_id, unnest({_SQL_LINKS}) AS link, unnest(range(len({_SQL_LINKS}))) AS position FROM pages)
       WHERE contains(link, 'a')"""
)
def extract_links(t: Tables) -> DataFrame:
    return web.extract_links(t.pages, "a", "https://archive.example.org")


@query(
    f"""SELECT page_id, CASE WHEN starts_with(link, '/') THEN 'https://archive.example.org' || link ELSE link END AS link
       FROM (SELECT page_id, list_filter({_SQL_LINKS}, lambda x: contains(x, 'an'))[1] AS link FROM pages)
       WHERE link IS NOT NULL"""
)
def first_link_per_page(t: Tables) -> DataFrame:
    return web.first_link_per_page(t.pages, "an", "https://archive.example.org")


@query(
    r"""SELECT page_id, CAST(position AS INTEGER) AS position, link FROM (
          SELECT page_id, unnest(links) AS link, unnest(range(len(links))) AS position
          FROM (SELECT page_id, list_concat(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a\s[^>]*?href="([^"]*)"', 1), ['/inner/' || CAST(page_id AS VARCHAR)]) AS links FROM pages))"""
)
def section_links(t: Tables) -> DataFrame:
    """Anchors of the menu alone. An element of the same kind inside it does not end it; anchors in front, behind and in comments are left out."""
    inner = F.concat(F.lit('<nav><a href="/inner/'), F.col("page_id").cast("string"), F.lit('"></a></nav></nav><a href="/behind">x</a>'))
    html = F.replace(F.replace("html", F.lit("</nav>"), inner), F.lit("<nav><ul>"), F.lit('<a href="/front">x</a><nav id="top" class="wide menu"><!-- <a href="/no"> --><ul>'))
    return web.extract_links(t.pages.withColumn("html", html), section=".menu")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '+49' || CAST(page_id AS VARCHAR) END AS tel FROM pages")
def extract_contact(t: Tables) -> DataFrame:
    """Every third page gets a telephone link put behind its own text."""
    link = F.concat(F.lit('<a class="c" href="tel:+49'), F.col("page_id").cast("string"), F.lit('">Ruf</a>'))
    pages = t.pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", link)).otherwise(F.col("html")))
    return web.extract_contact(pages)


def offered_files(t: Tables) -> DataFrame:
    """Archive links made from pages; every fifth is no CSV file."""
    number = F.col("page_id")
    kind = F.when(number % 5 == 0, ".pdf").otherwise(".csv")
    day = F.date_add(F.lit("2020-05-01").cast("date"), number.cast("int"))
    url = F.concat(
        F.lit("https://archive.example.org/bitstream/handle/a/b/"), F.date_format(day, "yyyy-MM-dd"),
        F.lit("_12-15_teilbare_divi_daten"), kind, F.lit("?sequence="), number.cast("string"),
    )
    return t.pages.select("page_id", url.alias("url")).withColumn("file_name", reports.archive_file_name("url"))


_SQL_FILES = """SELECT page_id, 'divi-intensivregister-' || strftime(DATE '2020-05-01' + CAST(page_id AS INTEGER), '%Y-%m-%d')
         || '-12-15' || CASE WHEN page_id % 5 = 0 THEN '.pdf' ELSE '.csv' END AS file_name FROM pages"""


@query(_SQL_FILES)
def archive_file_name(t: Tables) -> DataFrame:
    return offered_files(t).select("page_id", "file_name")


@query(f"SELECT * FROM ({_SQL_FILES}) WHERE ends_with(file_name, '.csv') AND page_id % 2 = 1")
def new_files_only(t: Tables) -> DataFrame:
    stored = offered_files(t).filter("page_id % 2 = 0")
    return reports.new_files_only(offered_files(t), stored).select("page_id", "file_name")


@query("SELECT strftime(max(CAST(o_orderdate AS DATE)), '%Y-%m-%d') || '-12-15' AS stamp FROM orders")
def latest_report_stamp(t: Tables) -> DataFrame:
    stamp = F.concat(F.to_date("o_orderdate").cast("string"), F.lit(" 12:15:00"))
    return reports.latest_report_stamp(t.orders.select(stamp.alias("daten_stand")))


@query(
    f"""SELECT position, RS, {', '.join(REPORT_MEASURES)} FROM features
        LEFT JOIN (SELECT * FROM icu_clean WHERE date = (SELECT max(date) FROM icu_clean)) ON gemeinde = RS"""
)
def enrich_features(t: Tables) -> DataFrame:
    df = geo.enrich_features(s.features(t), s.icu_clean(t))
    return df.select("position", F.get_json_object("properties", "$.RS").alias("RS"), *REPORT_MEASURES)
