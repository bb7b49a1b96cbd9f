"""Dates: parsing, epoch values, restriction levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardwatch.functions.nulls import as_column

# Last day of each restriction level, then the level that holds afterwards.
RESTRICTIONS = [
    ("2020-03-23", 0),
    ("2020-05-03", 3),
    ("2020-11-02", 1),
    ("2020-12-16", 2),
    ("2021-03-04", 3),
    ("2021-04-19", 2),
    ("2021-05-01", 1),
    ("2021-08-07", 0),
]
RESTRICTION_AFTERWARDS = 1
# The shorter list of the analysis notebook.
NOTEBOOK_RESTRICTIONS = [
    ("2020-03-23", 0),
    ("2020-05-03", 3),
    ("2020-11-02", 1),
    ("2020-12-16", 2),
]
NOTEBOOK_AFTERWARDS = 3


def restriction_level(
    date: Column | str,
    steps: list[tuple[str, int]] = RESTRICTIONS,
    afterwards: int = RESTRICTION_AFTERWARDS,
) -> Column:
    """The level in force on a date: the first step whose last day is not yet over."""
    date = as_column(date)
    level = F.lit(afterwards)
    for last_day, value in reversed(steps):
        level = F.when(date <= F.lit(last_day).cast("date"), F.lit(value)).otherwise(level)
    return level


def date_from_epoch_ms(value: Column | str) -> Column:
    """The UTC date of a time in milliseconds, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(as_column(value) / 86_400_000).cast("int"))


def parse_date(value: Column | str) -> Column:
    """``yyyy-MM-dd`` or ``yyyy/MM/dd`` at the start of the text, whatever follows; null if there is none."""
    found = F.regexp_extract(as_column(value), r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1)
    return F.try_to_date(F.regexp_replace(found, "/", "-"), "y-M-d")


def parse_timestamp(value: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with ``-``, ``/`` and a space or ``T`` as separators; null if it does not fit."""
    found = F.regexp_extract(
        as_column(value), r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2}[ T]\d{1,2}:\d{2}:\d{2})", 1
    )
    return F.try_to_timestamp(F.translate(found, "/T", "- "), F.lit("y-M-d H:m:s"))


def parse_german_timestamp(value: Column | str) -> Column:
    """``dd.MM.yyyy, HH:mm`` with any text after it, such as "Uhr"; null if it does not fit."""
    found = F.regexp_extract(as_column(value), r"^\s*(\d{1,2}\.\d{1,2}\.\d{4},? +\d{1,2}:\d{2})", 1)
    return F.try_to_timestamp(F.regexp_replace(found, r",? +", " "), F.lit("d.M.y H:m"))


def day_number(date: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(as_column(date))
