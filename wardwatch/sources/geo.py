"""GeoJSON features: reading, enrichment, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from wardwatch.operators.filters import latest_global
from wardwatch.operators.reshape import rbind
from wardwatch.sources.reports import REPORT_MEASURES

COLLECTION_SCHEMA = "struct<features array<struct<type string, properties variant, geometry variant>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files, one collection per file, with their position. Properties and geometry are variants."""
    collections = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", COLLECTION_SCHEMA)
    named = collections.select(F.col("_metadata.file_path").alias("file"), F.posexplode(parsed["features"]).alias("position", "f"))
    return named.select("file", "position", "f.*")


def as_variant(df: DataFrame, name: str) -> Column:
    """A column of variants; JSON text is parsed."""
    return F.parse_json(name) if df.schema[name].dataType == StringType() else F.col(name)


def property_of(df: DataFrame, key: str) -> Column:
    """A property of each feature as text."""
    return F.try_variant_get(as_variant(df, "properties"), f"$.{key}", "string")


def enrich_features(features: DataFrame, icu: DataFrame) -> DataFrame:
    """Add the newest bed figures of its county to each feature; features of unknown counties stay.

    Where a county has several report stamps on the last day, the newest one counts, so each feature stays one row.
    """
    stamp = F.col("daten_stand") if "daten_stand" in icu.columns else F.lit(None).cast("string")
    figures = F.max_by(F.struct(*REPORT_MEASURES), F.struct(stamp.isNotNull(), stamp)).alias("_figures")
    latest = latest_global(icu).groupBy(F.col("gemeinde").alias("_rs")).agg(figures).select("_rs", "_figures.*")
    joined = features.join(latest, property_of(features, "RS") == F.col("_rs"), "left")
    return joined.select(*_place(features), "properties", "geometry", *REPORT_MEASURES)


def _place(features: DataFrame) -> list[str]:
    """What orders features: the file, if known, and the position in it."""
    return [c for c in ("file", "position") if c in features.columns]


def feature_json(df: DataFrame, measures: list[str] = REPORT_MEASURES) -> DataFrame:
    """Each feature as JSON text, with the measures that are known among its properties.

    Properties and geometry keep their values as they are, nested or not; a measure takes the place of a property of its name.
    """
    known = F.map_filter(F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m).cast("variant"))]), lambda _, v: v.isNotNull())
    own = F.coalesce(as_variant(df, "properties").cast("map<string, variant>"), F.create_map().cast("map<string, variant>"))
    bag = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(known, k)), known)
    geometry = F.coalesce(as_variant(df, "geometry"), F.parse_json(F.lit("null")))
    feature = F.struct(F.lit("Feature").alias("type"), bag.alias("properties"), geometry.alias("geometry"))
    return df.select(*_place(df), F.to_json(feature).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Write one feature collection as text parts that form valid JSON when joined in name order.

    Features of several files follow each other by file and position; these two tell all features apart. Opening, features and closing are rows of a range-partitioned sort, so no task holds the whole collection.
    """
    spark = features.sparkSession
    place = F.struct(F.lit(1).alias("part"), *_place(features))
    kind = features.select(place.alias("p")).schema["p"].dataType.simpleString()
    ends = spark.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "part int, value string")
    blank = [F.lit(None).cast(features.schema[c].dataType).alias(c) for c in _place(features)]
    ends = ends.select(F.struct("part", *blank).cast(kind).alias("place"), "value")
    first = features.agg(F.min(place)).scalar()
    comma = F.when(place > first, F.lit(",")).otherwise(F.lit(""))
    rows = features.select(place.alias("place"), F.concat(comma, F.col("value")).alias("value"))
    rbind(rows, ends).orderBy("place").select("value").write.mode("overwrite").text(path)
