"""Aggregations. All of them combine on the map side before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwatch.functions.nulls import strict_sum, sum_or_zero
from wardwatch.operators.measures import covid_share, occupancy


def resum(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sum the measures per key again, for keys that were merged; null if any part is null."""
    return df.groupBy(*keys).agg(*[strict_sum(m).alias(m) for m in measures])


def cases_by_age(df: DataFrame) -> DataFrame:
    """Cases and deaths per state, county, day and age group."""
    return df.groupBy("IdBundesland", "IdLandkreis", "Refdatum", "Altersgruppe").agg(
        strict_sum("AnzahlFall").alias("cases"), strict_sum("AnzahlTodesfall").alias("deaths")
    )


def national_total_row(county: DataFrame) -> DataFrame:
    """The county table with one more row for the whole nation under key "0".

    Grouping sets read the counties once for both; a county is one row, so any of its values is its value.
    """
    sums = ["area", "pop_all", "pop_male", "pop_female"]
    texts = ["type", "name", "NUTS3", "pop_per_km2"]
    rolled = county.groupingSets([[F.col("key")], []], F.col("key")).agg(
        F.grouping("key").alias("_total"),
        *[strict_sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in texts],
    )
    total = F.col("_total") == 1

    def either(nation: Column, column: str) -> Column:
        return F.when(total, nation).otherwise(F.col(column)).alias(column)

    return rolled.select(
        either(F.lit("0"), "key"),
        either(F.lit("Land"), "type"),
        either(F.lit("Deutschland"), "name"),
        either(F.lit("DE"), "NUTS3"),
        *sums,
        either(F.try_divide("pop_all", "area"), "pop_per_km2"),
    )


def daily_totals(icu: DataFrame) -> DataFrame:
    """National day totals; each column has its own null rule."""
    return icu.groupBy("date").agg(
        strict_sum("faelle_covid_aktuell_beatmet").alias("sum_intub"),
        strict_sum("faelle_covid_aktuell").alias("sum_covid"),
        sum_or_zero("AnzFallErkrankung").alias("sum_newCases"),
        sum_or_zero("KumFall").alias("sum_cumCases"),
        F.avg("Incidence_7d_per_100k").alias("mean_7dIncidence"),
    )


def national_stats(icu: DataFrame) -> DataFrame:
    return icu.groupBy("date").agg(
        strict_sum("area").alias("sum_area"),
        strict_sum("pop_all").alias("sum_pop"),
        strict_sum("anzahl_standorte").alias("sum_standorte"),
        strict_sum("betten_frei").alias("sum_free_beds"),
        strict_sum("betten_belegt").alias("sum_occup_beds"),
    )


def national_icu(icu: DataFrame) -> DataFrame:
    return icu.groupBy("date").agg(
        strict_sum("faelle_covid_aktuell").alias("sum_faelle_covid_aktuell"),
        strict_sum("faelle_covid_aktuell_beatmet").alias("sum_faelle_covid_aktuell_beatmet"),
    )


def national_occupancy(icu: DataFrame) -> DataFrame:
    """Shares of the national sums, not means of county shares."""
    sums = icu.groupBy("date").agg(
        strict_sum("betten_frei").alias("sum_betten_frei"),
        strict_sum("betten_belegt").alias("sum_betten_belegt"),
        strict_sum("faelle_covid_aktuell").alias("sum_faelle_covid_aktuell"),
    )
    return sums.withColumns(
        {
            "pct_covid": covid_share("sum_faelle_covid_aktuell", "sum_betten_belegt"),
            "auslastung": occupancy("sum_betten_belegt", "sum_betten_frei"),
        }
    )


def state_icu(icu: DataFrame) -> DataFrame:
    return (
        icu.dropna(subset=["bundesland"])
        .groupBy("date", "bundesland")
        .agg(strict_sum("faelle_covid_aktuell").alias("sum_faelle_covid_aktuell"))
    )


def county_daily(case_age: DataFrame) -> DataFrame:
    """Cases and deaths per county and day over all age groups."""
    return case_age.groupBy("IdLandkreis", "Refdatum").agg(
        strict_sum("cases").alias("cases"), strict_sum("deaths").alias("deaths")
    )


def dose_totals(vaccination: DataFrame) -> DataFrame:
    return vaccination.groupBy("IdLandkreis", "vcCount", "date").agg(strict_sum("cum_count").alias("cum_count"))


def distinct_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``.

    A minimum over structs keeps one row per key and task before the shuffle, so a hot key costs nothing.
    """
    others = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_first")
    return df.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in others])


def max_date(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.max(date).alias("max_date"))


def map_viewport(sites: DataFrame, *keys: str) -> DataFrame:
    """Mid-range centre, extent and zoom of each group's sites; a single point has no zoom."""
    def span(axis: str) -> Column:
        return F.abs(F.abs(F.col(f"_{axis}_hi")) - F.abs(F.col(f"_{axis}_lo")))

    extent = F.greatest(span("lat"), span("lon"))
    return (
        sites.groupBy(*keys)
        .agg(
            F.min("latitude").alias("_lat_lo"),
            F.max("latitude").alias("_lat_hi"),
            F.min("longitude").alias("_lon_lo"),
            F.max("longitude").alias("_lon_hi"),
        )
        .select(
            *keys,
            ((F.col("_lon_hi") + F.col("_lon_lo")) / 2).alias("center_lon"),
            ((F.col("_lat_hi") + F.col("_lat_lo")) / 2).alias("center_lat"),
            extent.alias("extent"),
            F.when(extent > 0, -1.35 * F.ln(extent) + 8).alias("zoom"),
        )
    )


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """The exact median of a column of any size, as a one-row frame.

    A quantile sketch with a guaranteed rank error brackets the middle; only the distinct values inside the
    bracket, some 0.1 % of the rows at most, are then sorted by rank.
    """
    values = df.select(F.col(column).alias("v")).dropna()
    sketch = F.percentile_approx("v", F.array(F.lit(0.4995), F.lit(0.5005)), 10000)
    bounds = values.agg(F.struct(F.count(F.lit(1)).alias("n"), sketch.alias("q")).alias("b")).scalar()
    low, high, size = bounds["q"][0], bounds["q"][1], bounds["n"]
    counts = (
        values.groupBy(F.when(F.col("v") < low, F.lit(None)).otherwise(F.col("v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
        .filter(F.col("v").isNull() | (F.col("v") <= high))
    )
    slice_of = F.coalesce(F.least(F.floor((F.col("v") - low) / (high - low) * SLICES), F.lit(SLICES - 1)), F.lit(0))
    part = F.when(F.col("v").isNull(), -1).when(low == high, 0).otherwise(slice_of).cast("int")
    return _middle(counts.withColumn("part", part), size).select(F.col("m").alias(column))


SLICES = 1000  # of the bracket; running counts start anew in each


def _middle(counts: DataFrame, size: Column) -> DataFrame:
    """Mean of the one or two middle values of (value, count, part) rows; null values come first.

    Parts are slices of the value range. Their totals, one row for each slice, say where a slice's running count begins,
    so no task sees more than a slice.
    """
    totals = counts.groupBy("part").agg(F.sum("c").alias("n"))
    known = totals.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("known"))

    def first_of(slice_: Column, number: Column) -> Column:
        before = F.slice("known", F.lit(1), number)
        start = F.aggregate(before, F.lit(0).cast("long"), lambda total, p: total + p["n"])
        return F.struct(slice_["part"].alias("part"), start.alias("start"))

    starts = known.select(F.inline(F.transform("known", first_of)))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy(F.col("v").asc_nulls_first())) + F.col("start")
    ranked = counts.join(starts, "part").select("v", upto.alias("upto"), (upto - F.col("c")).alias("before"))
    lower, upper = F.floor((size + 1) / 2), F.floor(size / 2) + 1
    hit = ((F.col("before") < lower) & (lower <= F.col("upto"))) | (
        (F.col("before") < upper) & (upper <= F.col("upto"))
    )
    return ranked.filter(hit).agg(((F.min("v") + F.max("v")) / 2).alias("m"))
