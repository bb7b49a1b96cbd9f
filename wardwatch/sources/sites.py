"""Hospital sites and their reporting sections: nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SITE_SCHEMA = """
    krankenhausStandort struct<
        id string, bezeichnung string, strasse string, hausnummer string, plz string, ort string,
        bundesland string, ikNummer string, position struct<latitude double, longitude double>>,
    letzteMeldezeitpunkt string,
    maxBettenStatusEinschaetzungLowCare string,
    maxBettenStatusEinschaetzungHighCare string,
    maxBettenStatusEinschaetzungEcmo string,
    meldebereiche array<struct<
        meldebereichId string, meldebereichBezeichnung string, ardsNetzwerkMitglied string>>
"""
STATUS_COLUMNS = [
    "maxBettenStatusEinschaetzungLowCare",
    "maxBettenStatusEinschaetzungHighCare",
    "maxBettenStatusEinschaetzungEcmo",
]
# Headings of the section table.
SECTION_HEADINGS = {
    "bezeichnung": "Bereich",
    "letzteMeldung": "Letzte Meldung",
    "behandlungsschwerpunktL1": "Behandlungsschwerpunkt",
    "behandlungsschwerpunktL2": "Spezialisierung",
    "ansprechpartner": "Ansprechpartner",
}


def parse_sites(documents: DataFrame, column: str = "value") -> DataFrame:
    """Site rows from JSON texts, either one site or ``{"data": [sites]}`` per text."""
    whole = F.from_json(column, f"struct<data array<struct<{SITE_SCHEMA}>>>")
    single = F.from_json(column, f"struct<{SITE_SCHEMA}>")
    sites = F.coalesce(whole["data"], F.array(single))
    return documents.select(F.explode(sites).alias("s")).select("s.*")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site rows from JSON files with one site per line."""
    return spark.read.schema(SITE_SCHEMA).json(path)


SECTION_SCHEMA = """id string, sections array<struct<bezeichnung string, letzteMeldung string, behandlungsschwerpunktL1 string,
    behandlungsschwerpunktL2 string, ansprechpartner array<string>, tags array<string>>>"""


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """A row for each reporting section, from JSON files with one site per line."""
    sites = spark.read.schema(SECTION_SCHEMA).json(path)
    return sites.select("id", F.explode("sections").alias("s")).select("id", "s.*")


def flatten_sites(sites: DataFrame) -> DataFrame:
    """One flat row per site."""
    place = "krankenhausStandort"
    names = ["id", "bezeichnung", "strasse", "hausnummer", "plz", "ort", "bundesland", "ikNummer"]
    return sites.select(
        *[F.col(f"{place}.{n}").alias(n) for n in names],
        F.col(f"{place}.position.latitude").alias("latitude"),
        F.col(f"{place}.position.longitude").alias("longitude"),
        "letzteMeldezeitpunkt",
        *STATUS_COLUMNS,
    )


def explode_units(sites: DataFrame) -> DataFrame:
    """One row per reporting unit; a site without units keeps one row with nulls."""
    units = sites.select(F.col("krankenhausStandort.id").alias("id"), F.explode_outer("meldebereiche").alias("u"))
    return units.select(
        "id",
        F.col("u.meldebereichId").alias("unitId"),
        F.col("u.ardsNetzwerkMitglied").alias("ardsNetwork"),
        F.col("u.meldebereichBezeichnung").alias("unitName"),
    )


def section_details(sections: DataFrame, *keep: str) -> DataFrame:
    """Sections under their display headings, lists as text."""
    kept = sections.select(*keep, *SECTION_HEADINGS, "tags")
    joined = kept.withColumns({c: F.array_join(c, ", ", "NA") for c in ("ansprechpartner", "tags")})
    return joined.withColumnsRenamed(SECTION_HEADINGS)
