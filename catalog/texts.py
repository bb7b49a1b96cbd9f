"""Scalar functions on text, numbers and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.base import Tables, half_even, query
from wardwatch.functions import dates, text as tx
from wardwatch.functions.nulls import ratio, round_even as halves


def sql_number(x: str) -> str:
    """SQL for ``plain_number``."""
    return (
        f"CASE WHEN {x} IS NULL THEN 'NA' WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
        f"ELSE CAST({x} AS VARCHAR) END"
    )


@query(
    f"""SELECT o_orderkey, translate(format('{{:,.2f}}', o_totalprice), ',.', '.,') AS money,
         translate(format('{{:,}}', o_custkey), ',.', '.,') AS whole,
         CASE WHEN d > 0 THEN '+' ELSE '' END || {sql_number('d')} AS signed,
         regexp_replace(o_orderpriority, '[^0-9]', '', 'g') AS digits,
         'Status: ' || o_orderstatus || '<br />Tag: ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS block
       FROM (SELECT *, CAST(o_custkey - 700 AS DOUBLE) AS d FROM orders)"""
)
def text_formats(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        tx.format_de("o_totalprice", 2).alias("money"),
        tx.format_de("o_custkey").alias("whole"),
        tx.signed(F.col("o_custkey").cast("double") - 700).alias("signed"),
        tx.digits_only("o_orderpriority").alias("digits"),
        tx.text_block(
            tx.labelled("Status: ", tx.or_na("o_orderstatus")),
            tx.labelled("Tag: ", tx.or_na(F.to_date("o_orderdate"))),
        ).alias("block"),
    )


@query(
    """SELECT c_custkey, CAST(length(c_name) AS INTEGER) AS len, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS joined,
         substring(c_name, 10) AS tail, regexp_replace(c_name, '0', 'o') AS first_only,
         regexp_replace(c_name, '0', '', 'g') AS removed, string_split(c_name, '#')[2] AS piece
       FROM customer"""
)
def text_pieces(t: Tables) -> DataFrame:
    """Length, joining, sub-strings, first and all replacements, pieces."""
    return t.customer.select(
        "c_custkey",
        F.length("c_name").alias("len"),
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("joined"),
        F.expr("substring(c_name, 10)").alias("tail"),
        F.regexp_replace("c_name", "^([^0]*)0", "$1o").alias("first_only"),
        F.regexp_replace("c_name", "0", "").alias("removed"),
        F.get(F.split("c_name", "#"), F.lit(1)).alias("piece"),
    )


@query(
    """SELECT o_orderkey, d AS day, d AS from_epoch, CAST(d AS TIMESTAMP) + INTERVAL 9 HOUR AS stamp,
         CAST(d AS TIMESTAMP) + INTERVAL 9 HOUR AS german, CAST(d + 14 AS DATE) AS later, CAST(d - 28 AS DATE) AS earlier,
         CAST(month(d) AS INTEGER) AS month, CAST(d - DATE '1970-01-01' AS INTEGER) AS number, CAST(NULL AS DATE) AS none
       FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def date_functions(t: Tables) -> DataFrame:
    """Dates read back from the texts and numbers the feeds use."""
    df = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    iso = F.date_format("d", "yyyy/MM/dd")
    return df.select(
        "o_orderkey",
        dates.parse_date(F.concat(F.col("d").cast("string"), F.lit(".csv"))).alias("day"),
        dates.date_from_epoch_ms(F.unix_date("d").cast("long") * 86_400_000).alias("from_epoch"),
        dates.parse_timestamp(F.concat(iso, F.lit(" 09:00:00+00"))).cast("timestamp_ntz").alias("stamp"),
        dates.parse_german_timestamp(F.date_format("d", "dd.MM.yyyy', 09:00 Uhr'")).cast("timestamp_ntz").alias("german"),
        F.date_add("d", 14).alias("later"),
        F.date_sub("d", 28).alias("earlier"),
        F.month("d").alias("month"),
        dates.day_number("d").alias("number"),
        dates.parse_date(F.lit("no date")).alias("none"),
    )


@query(
    f"""SELECT l_orderkey, l_linenumber, {half_even('l_quantity / 4', 0)} AS half,
         {half_even('l_extendedprice / nullif(l_quantity - 10, 0)', 1)} AS price,
         abs(l_discount - l_tax) AS gap, greatest(l_discount, l_tax) AS most, ln(l_quantity) AS log
       FROM lineitem"""
)
def number_functions(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        halves(F.col("l_quantity") / 4).alias("half"),
        halves(ratio("l_extendedprice", F.col("l_quantity") - 10), 1).alias("price"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        F.greatest("l_discount", "l_tax").alias("most"),
        F.ln("l_quantity").alias("log"),
    )
