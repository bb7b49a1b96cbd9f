"""Text for cards and hover boxes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardwatch.functions.nulls import as_column

LINE_BREAK = "<br />"


def format_de(value: Column | str, digits: int = 0) -> Column:
    """Number text with ``.`` between thousands and a decimal comma."""
    return F.translate(F.format_number(as_column(value), digits), ",.", ".,")


def plain_number(value: Column | str) -> Column:
    """Number text without ``.0`` for whole numbers; null becomes ``NA``."""
    value = as_column(value).cast("double")
    whole = F.when(value == F.floor(value), value.cast("long").cast("string"))
    return F.coalesce(whole, value.cast("string"), F.lit("NA"))


def or_na(value: Column | str) -> Column:
    """Text in which null shows as ``NA``."""
    return F.coalesce(as_column(value).cast("string"), F.lit("NA"))


def signed(value: Column | str) -> Column:
    """Number text with a ``+`` in front of positive numbers."""
    value = as_column(value)
    return F.concat(F.when(value > 0, F.lit("+")).otherwise(F.lit("")), plain_number(value))


def text_block(*lines: Column, separator: str = LINE_BREAK) -> Column:
    return F.concat_ws(separator, *lines)


def labelled(label: str, *parts: Column) -> Column:
    return F.concat(F.lit(label), *parts)


def digits_only(value: Column | str) -> Column:
    return F.regexp_replace(as_column(value).cast("string"), "[^0-9]", "")
