"""Null, rounding, key and date rules on small literal frames."""

import datetime as dt

from pyspark.sql import functions as F

import pytest

from wardwatch.functions import dates, keys, nulls, text
from wardwatch.operators import aggregates, clean, filters, measures, reshape, windows


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def day(n):
    return dt.date(2021, 3, 1) + dt.timedelta(days=n)


def test_sums_follow_their_own_null_rule(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, None)], "a double, b double")
    row = one(df.agg(nulls.strict_sum("a").alias("s"), nulls.sum_or_zero("a").alias("z"), nulls.sum_or_zero("b").alias("e")))
    assert (row.s, row.z, row.e) == (None, 3.0, 0.0)


def test_strict_sum_of_complete_values(spark):
    df = spark.createDataFrame([(1.0,), (2.5,)], "a double")
    assert one(df.agg(nulls.strict_sum("a").alias("s"))).s == 3.5


def test_zero_divisor_gives_null(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (1.0, 3.0)], "used double, free double")
    got = [r.o for r in df.select(measures.occupancy("used", "free").alias("o")).collect()]
    assert got == [None, 100.0, 25.0]
    assert one(df.limit(1).select(measures.covid_share("used", "free").alias("c"))).c is None


def test_rounding_goes_to_the_even_neighbour(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r.r for r in df.select(nulls.round_even("x").alias("r")).collect()] == [0.0, 2.0, 2.0, 0.0]


def test_bad_numbers_become_null(spark):
    df = spark.createDataFrame([("3",), ("NA",), ("",), ("x1",), (None,)], "t string")
    assert [r.t for r in clean.cast_many(df, ["t"]).collect()] == [3.0, None, None, None, None]


def test_keys_are_padded_only_at_four_characters(spark):
    df = spark.createDataFrame([("0",), ("1001",), ("11000",), ("0100",)], "k string")
    got = df.select(keys.pad_county_key("k").alias("a"), keys.pad_report_key("k").alias("b")).collect()
    assert [r.a for r in got] == ["0", "01001", "11000", "00100"]
    assert [r.b for r in got] == ["0", "01001", "11000", "0100"]


def test_merging_keys_keeps_the_total(spark):
    rows = [("11001", 1), ("11012", 2), ("11000", 4), ("11013", 8), ("09473", 16), ("02700", 32)]
    df = spark.createDataFrame(rows, "k string, n long")
    key = keys.merge_county_key("k", keys.BERLIN_BOROUGHS, keys.BAVARIAN_MERGERS, keys.HAMBURG_PARTS)
    merged = aggregates.resum(df.withColumn("k", key), ["k"], ["n"])
    assert {r.k: r.n for r in merged.collect()} == {"11000": 7, "11013": 8, "09463": 16, "02000": 32}


def test_windows_count_rows_or_days(spark):
    rows = [("a", day(0), 1), ("a", day(1), 2), ("a", day(9), 4), ("a", day(10), None), ("a", day(11), 8)]
    df = spark.createDataFrame(rows, "k string, d date, x long")
    w = windows.per_series(["k"], "d")
    got = df.select(
        "d",
        windows.trailing_sum("x", w, 3).alias("rows"),
        windows.trailing_sum_days("x", ["k"], "d", 3).alias("days"),
        windows.cumulative("x", w).alias("total"),
    ).orderBy("d").collect()
    assert [r.rows for r in got] == [1, 3, 7, None, None]
    assert [r.days for r in got] == [1, 3, 4, None, None]
    assert [r.total for r in got] == [1, 3, 7, None, None]


def test_new_cases_undo_the_running_total(spark):
    rows = [(k, day(n), (n * 7 + len(k)) % 5) for k in ("a", "bb") for n in range(30)]
    df = spark.createDataFrame(rows, "k string, d date, x long")
    w = windows.per_series(["k"], "d")
    back = df.withColumn("t", windows.cumulative("x", w)).withColumn("y", windows.new_from_cumulative("t", w))
    assert back.filter("x <> y OR y IS NULL").count() == 0


def test_fill_takes_one_original_step(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), None), ("a", day(2), None)], "k string, d date, x double")
    got = df.withColumn("f", windows.fill_from_previous("x", windows.per_series(["k"], "d"))).orderBy("d").collect()
    assert [r.f for r in got] == [1.0, 1.0, None]


def test_latest_is_global_or_per_county(spark):
    df = spark.createDataFrame([("a", day(0)), ("a", day(2)), ("b", day(1)), ("b", day(1))], "gemeinde string, date date")
    assert [r.gemeinde for r in filters.latest_global(df).collect()] == ["a"]
    assert sorted((r.gemeinde, r.date) for r in filters.latest_per_county(df).collect()) == [
        ("a", day(2)), ("b", day(1)), ("b", day(1))
    ]
    assert filters.last_n_days(df, 1).count() == 3


def test_restriction_levels_at_their_edges(spark):
    edges = ["2020-03-23", "2020-03-24", "2020-12-16", "2020-12-17", "2021-08-07", "2021-08-08"]
    df = spark.createDataFrame([(e,) for e in edges], "t string").withColumn("d", F.to_date("t"))
    notebook = dates.restriction_level("d", dates.NOTEBOOK_RESTRICTIONS, dates.NOTEBOOK_AFTERWARDS)
    got = df.select(dates.restriction_level("d").alias("a"), notebook.alias("b")).collect()
    assert [r.a for r in got] == [0, 3, 2, 3, 0, 1]
    assert [r.b for r in got] == [0, 3, 2, 3, 3, 3]


def test_dates_ignore_what_follows(spark):
    df = spark.createDataFrame([("2021-05-01.csv", "1.5.2021, 00:00 Uhr"), ("total", "")], "a string, b string")
    first, second = df.select(dates.parse_date("a").alias("a"), dates.parse_german_timestamp("b").alias("b")).collect()
    assert (first.a, first.b) == (dt.date(2021, 5, 1), dt.datetime(2021, 5, 1))
    assert (second.a, second.b) == (None, None)


def test_texts(spark):
    df = spark.createDataFrame([(1234567.5, 2.5), (1000.0, -3.0), (None, None)], "x double, c double")
    got = df.select(text.format_de("x", 1).alias("d"), text.plain_number("x").alias("p"), text.signed("c").alias("s")).collect()
    assert [r.d for r in got] == ["1.234.567,5", "1.000,0", None]
    assert [r.p for r in got] == ["1234567.5", "1000", "NA"]
    assert [r.s for r in got] == ["+2.5", "-3", "NA"]


def test_first_row_wins_per_key_and_hot_keys_stay_whole(spark):
    hot = [("10115", n, f"c{n}") for n in range(3000, 0, -1)]
    df = spark.createDataFrame([*hot, ("20095", 9, "x")], "zip string, line long, code string")
    got = {r.zip: (r.line, r.code) for r in aggregates.distinct_first(df, "zip", ["line"]).collect()}
    assert got == {"10115": (1, "c1"), "20095": (9, "x")}


def test_unknown_codes_become_null_with_fixed_order(spark):
    df = spark.createDataFrame([("BEGRENZT",), ("???",)], "s string")
    got = clean.relabel_status(df, ["s"]).collect()
    assert [(r.s, r.s_rank) for r in got] == [("Begrenzt", 2), (None, None)]


def test_state_names_by_number(spark):
    df = spark.createDataFrame([(1.0,), (16.0,), (0.0,), (17.0,), (None,)], "s double")
    assert [r.n for r in df.select(clean.state_name("s").alias("n")).collect()] == [
        "Schleswig-Holstein", "Thüringen", None, None, None
    ]


def test_densify_fills_every_age_however_many_there_are(spark):
    rows = [(day(0), "k", 1, "12-17", 3), (day(0), "k", 1, "60+", 2), (day(1), "k", 1, "60+", 1)]
    df = spark.createDataFrame(rows, "date date, IdLandkreis string, vcCount int, Altersgruppe string, count long")
    got = {(r.date, r.Altersgruppe): r["count"] for r in reshape.densify(df).collect()}
    assert got == {(day(0), "12-17"): 3, (day(0), "60+"): 2, (day(1), "12-17"): 0, (day(1), "60+"): 1}
    many = [(day(0), "k", 1, f"age {n}", n) for n in range(1500)] + [(day(1), "k", 1, None, 7)]
    dense = reshape.densify(spark.createDataFrame(many, df.schema))
    assert dense.count() == 2 * 1501 and dense.filter("Altersgruppe = 'NA'").agg({"count": "sum"}).first()[0] == 7


def test_doses_widen_by_what_occurs_and_unlisted_ones_fail(spark):
    rows = [(day(0), "k", n, "12-17", n, 10 * n) for n in (1, 4)]
    df = spark.createDataFrame(rows, "date date, IdLandkreis string, vcCount int, Altersgruppe string, count long, cum_count long")
    row = reshape.pivot_dose_wide(df).first()
    assert (row.count_Vac4, row.cum_count_Vac1) == (4, 10)
    with pytest.raises(Exception, match="dose not listed"):
        reshape.pivot_dose_wide(df, [1, 2, 3]).collect()


def test_median_equals_brute_force(spark):
    for n in (1, 2, 3, 4, 999, 5000, 20001):
        values = [float((i * 7919) % 5003) for i in range(n)]
        middle = sorted(values)
        want = (middle[(n - 1) // 2] + middle[n // 2]) / 2
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert one(aggregates.exact_median(df, "v")).v == want


def test_median_with_a_third_of_all_rows_on_one_value(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 11).alias("v"))
    values = sorted(r.v for r in df.collect())
    assert one(aggregates.exact_median(df, "v")).v == (values[14999] + values[15000]) / 2


def test_viewport_of_a_single_site_has_no_zoom(spark):
    df = spark.createDataFrame([("a", 50.0, 8.0), ("b", 50.0, 8.0), ("b", 51.0, 8.5)], "k string, latitude double, longitude double")
    got = {r.k: r for r in aggregates.map_viewport(df, "k").collect()}
    assert got["a"].zoom is None and got["b"].extent == 1.0 and got["b"].zoom == 8.0


def test_national_total_has_its_own_density(spark):
    cols = "key string, type string, name string, NUTS3 string, area double, pop_all long, pop_male long, pop_female long, pop_per_km2 double"
    df = spark.createDataFrame(
        [("01001", "Kreis", "A", "DE1", 10.0, 100, 40, 60, 10.0), ("01002", "Kreis", "B", "DE2", 30.0, 60, 30, 30, 2.0)], cols
    )
    rows = {r.key: r for r in aggregates.national_total_row(df).collect()}
    assert rows["0"].pop_all == 160 and rows["0"].pop_per_km2 == 4.0 and rows["0"].name == "Deutschland"
    assert rows["01002"].name == "B" and len(rows) == 3


def test_union_of_equally_partitioned_frames_keeps_groups_whole(spark):
    """Spark 4.1 may split groups after a union of frames that AQE merged differently."""
    base = spark.range(2000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    left = base.groupBy("k").agg(F.sum("v").alias("v"))
    right = base.filter("k < 3").groupBy("k").agg(F.max("v").alias("v"))
    counts = reshape.rbind(left, right).groupBy("k").count()
    assert counts.count() == 50
