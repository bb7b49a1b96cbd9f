"""Pivots, unpivots and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwatch.functions.nulls import strict_sum

# Counties without intensive care.
COUNTIES_WITHOUT_ICU = [
    (7.0, "Rhein-Pfalz-Kreis", "07338"),
    (9.0, "Landkreis neustadt an der Waldnaab", "09374"),
    (9.0, "Landkreis Coburg", "09473"),
    (9.0, "Landkreis Fürth", "09573"),
]


def bind_rows(*frames: DataFrame, same_columns: bool = False) -> DataFrame:
    """Stack frames by column name; columns a frame lacks are null, or an error with ``same_columns``.

    Spark 4.1 may take the partitioning of a union from its inputs although AQE has merged their partitions
    differently; a later aggregation then skips its shuffle and returns a group twice. The setting turns that off.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=not same_columns)
    return stacked


def rbind(*frames: DataFrame) -> DataFrame:
    """Stack frames that have the same columns."""
    return bind_rows(*frames, same_columns=True)


def add_missing_counties(day: DataFrame) -> DataFrame:
    """The day's rows and the counties without intensive care, flagged by ``is_missing``."""
    spark = day.sparkSession
    missing = spark.createDataFrame(COUNTIES_WITHOUT_ICU, "bundesland double, name string, gemeinde string")
    missing = missing.select(
        "*",
        F.lit(0.0).alias("anzahl_standorte"),
        F.lit(0.0).alias("anzahl_meldebereiche"),
        F.lit("Kreis").alias("type"),
        F.lit(True).alias("is_missing"),
    )
    return bind_rows(day.withColumn("is_missing", F.lit(False)), missing)


def pivot_age_wide(df: DataFrame, ages: list[str], keys: list[str], value: str = "count") -> DataFrame:
    """One column per age group; one shuffle, no extra job for the column names.

    A row whose age group is not in ``ages`` fails the query, so that no count is lost unseen.
    """
    age = F.coalesce("Altersgruppe", F.lit("NA"))
    known = F.when(age.isin(ages), age).otherwise(
        F.raise_error(F.concat(F.lit("age group not listed: "), age))
    )
    columns = [strict_sum_where(known == a, value).alias(a) for a in ages]
    return df.groupBy(*keys).agg(*columns)


def strict_sum_where(condition, value: str):
    """``strict_sum`` over the rows that meet a condition; null where there are none."""
    hits = F.count_if(condition)
    nulls = F.count_if(condition & F.col(value).isNull())
    return F.when((hits > 0) & (nulls == 0), F.sum(F.when(condition, F.col(value))))


def densify(df: DataFrame) -> DataFrame:
    """Give every day, county and dose a row for each age group of the table, with count 0 where none was reported.

    The labels come as one array from an aggregate of the same table, however many there are. A sum with a null in it
    counts as 0 like a missing group.
    """
    keys = ["date", "IdLandkreis", "vcCount"]
    age = F.coalesce("Altersgruppe", F.lit("NA")).alias("Altersgruppe")
    sums = df.groupBy(*keys, age).agg(strict_sum("count").alias("count"))
    labels = df.agg(F.array_sort(F.collect_set(age)).alias("labels")).scalar()
    known = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("Altersgruppe", "count"))).alias("known"))
    every = known.select(*keys, "known", F.explode(labels).alias("Altersgruppe"))
    return every.select(*keys, "Altersgruppe", F.coalesce(F.element_at("known", F.col("Altersgruppe")), F.lit(0)).alias("count"))


def pivot_dose_wide(df: DataFrame, doses: list[int] | None = None) -> DataFrame:
    """Counts and running counts of each dose as ``count_Vac<n>`` and ``cum_count_Vac<n>``.

    ``doses`` are those that occur, unless given; then a row with another dose fails the query.
    """
    if doses is None:
        doses = sorted(r[0] for r in df.select("vcCount").dropna().distinct().collect())
    else:
        known = F.col("vcCount").isin(list(doses))
        unlisted = F.raise_error(F.concat(F.lit("dose not listed: "), F.col("vcCount").cast("string")))
        df = df.withColumn("vcCount", F.when(known | F.col("vcCount").isNull(), F.col("vcCount")).otherwise(unlisted.cast("int")))
    wide = (
        df.groupBy("date", "IdLandkreis", "Altersgruppe")
        .pivot("vcCount", list(doses))
        .agg(F.first("count").alias("count"), F.first("cum_count").alias("cum_count"))
    )
    names = {f"{n}_{m}": f"{m}_Vac{n}" for n in doses for m in ("count", "cum_count")}
    return wide.withColumnsRenamed(names)


def pivot_beds_long(df: DataFrame) -> DataFrame:
    """Free and occupied beds as rows of ``parameter`` and ``value``."""
    beds = ["betten_frei", "betten_belegt"]
    return df.unpivot([c for c in df.columns if c not in beds], beds, "parameter", "value")


def pivot_forecast_wide(df: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    """``value``, ``conf_lo`` and ``conf_hi`` side by side, with the variable as suffix."""
    parts = ("value", "conf_lo", "conf_hi")
    wide = df.groupBy(*keys).pivot("variable", variables).agg(*[F.first(p).alias(p) for p in parts])
    return wide.withColumnsRenamed({f"{v}_{p}": f"{p}_{v}" for v in variables for p in parts})
