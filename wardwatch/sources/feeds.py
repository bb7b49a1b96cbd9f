"""Case, vaccination and nowcast feeds, and the county and postcode dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardwatch.functions.dates import date_from_epoch_ms, parse_date, parse_german_timestamp, parse_timestamp
from wardwatch.functions.keys import BAVARIAN_MERGERS, BERLIN_BOROUGHS, merge_county_key, pad_county_key
from wardwatch.operators.aggregates import resum

# The columns of the feeds.
COUNTY_COLUMNS = ["key", "type", "name", "NUTS3", "area", "pop_all", "pop_male", "pop_female", "pop_per_km2"]
COUNTY_SCHEMA = (
    "key string, type string, name string, NUTS3 string, area double, "
    "pop_all long, pop_male long, pop_female long, pop_per_km2 double"
)
VACCINATION_SCHEMA = (
    "Impfdatum string, LandkreisId_Impfort string, Altersgruppe string, Impfschutz int, Anzahl long"
)
CASE_SCHEMA = (
    "IdBundesland int, IdLandkreis string, Altersgruppe string, AnzahlFall long, AnzahlTodesfall long, "
    "Meldedatum string, Refdatum string, Datenstand string"
)
# The columns of the nowcast feed, by position.
NOWCAST_COLUMNS = [
    "Date",
    "PredictedNew",
    "PredictedNew_Low",
    "PredictedNew_High",
    "PredictedNew_Interpolated",
    "PredictedNew_Interpolated_Low",
    "PredictedNew_Interpolated_High",
    "R7d",
    "R7d_Low",
    "R7d_High",
]
# The attributes of the history feed.
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("ObjectId", T.LongType()),
        T.StructField("BundeslandId", T.IntegerType()),
        T.StructField("AdmUnitId", T.StringType()),
        T.StructField("Datum", T.LongType()),
        T.StructField("AnzFallNeu", T.LongType()),
        T.StructField("AnzFallVortag", T.LongType()),
        T.StructField("AnzFallErkrankung", T.LongType()),
        T.StructField("AnzFallMeldung", T.LongType()),
        T.StructField("KumFall", T.LongType()),
    ]
)
HISTORY_MEASURES = ["AnzFallNeu", "AnzFallVortag", "AnzFallErkrankung", "AnzFallMeldung", "KumFall"]


def read_typed_csv(spark: SparkSession, paths: str | list[str], schema: str | T.StructType) -> DataFrame:
    """CSV files with a header and declared types, matched by position; no inference pass."""
    return spark.read.schema(schema).option("header", True).csv(paths)


def read_decimal_comma_csv(spark: SparkSession, path: str, names: list[str] = NOWCAST_COLUMNS) -> DataFrame:
    """CSV with decimal commas: a date column first, numbers after it; rows without a date go."""
    schema = ", ".join(f"{n} string" for n in names)
    raw = read_typed_csv(spark, path, schema)
    numbers = [F.replace(n, F.lit(","), F.lit(".")).try_cast("double").alias(n) for n in names[1:]]
    return raw.select(parse_date(names[0]).alias(names[0]), *numbers).dropna(subset=[names[0]])


def read_paged_json(spark: SparkSession, path: str, attributes: T.StructType = HISTORY_SCHEMA) -> DataFrame:
    """Rows of JSON pages of the form ``{"features": [{"attributes": {...}}]}``, one page per file."""
    feature = T.StructType([T.StructField("attributes", attributes)])
    page = T.StructType([T.StructField("features", T.ArrayType(feature))])
    pages = spark.read.schema(page).option("multiLine", True).json(path)
    return pages.select(F.explode("features").alias("f")).select("f.attributes.*")


def clean_history(raw: DataFrame) -> DataFrame:
    """One row per county and day from history attributes, boroughs merged."""
    keyed = raw.drop("ObjectId").withColumn("AdmUnitId", merge_county_key("AdmUnitId", BERLIN_BOROUGHS))
    summed = resum(keyed, ["BundeslandId", "AdmUnitId", "Datum"], HISTORY_MEASURES)
    return summed.select(
        pad_county_key("AdmUnitId").alias("gemeinde"),
        date_from_epoch_ms("Datum").alias("date"),
        "BundeslandId",
        *HISTORY_MEASURES,
    )


def clean_case_rows(raw: DataFrame) -> DataFrame:
    """Parse the dates of case rows and bring their county keys up to date."""
    key = merge_county_key(pad_county_key("IdLandkreis"), BERLIN_BOROUGHS, BAVARIAN_MERGERS)
    return raw.withColumns(
        {
            "Meldedatum": parse_timestamp("Meldedatum"),
            "Refdatum": parse_timestamp("Refdatum"),
            "Datenstand": parse_german_timestamp("Datenstand"),
            "IdLandkreis": key,
        }
    )


def clean_vaccination(raw: DataFrame) -> DataFrame:
    return raw.select(
        parse_date("Impfdatum").alias("date"),
        F.col("LandkreisId_Impfort").alias("IdLandkreis"),
        F.col("Impfschutz").alias("vcCount"),
        "Altersgruppe",
        F.col("Anzahl").alias("count"),
    )


def load_county_dim(raw: DataFrame) -> DataFrame:
    """The county dimension: nine named columns, rows without key or name dropped."""
    return raw.toDF(*COUNTY_COLUMNS).dropna(subset=["key", "name"])


def load_zip_dim(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The postcode table, all codes as text."""
    return read_typed_csv(spark, path, schema)
