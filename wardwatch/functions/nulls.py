"""Null-aware aggregates, ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strict_sum(value: Column | str) -> Column:
    """A sum that is null as soon as one input is null."""
    value = as_column(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def strict_sum_over(value: Column | str, window: WindowSpec) -> Column:
    """``strict_sum`` over a window frame."""
    value = as_column(value)
    complete = F.count(value).over(window) == F.count(F.lit(1)).over(window)
    return F.when(complete, F.sum(value).over(window))


def sum_or_zero(value: Column | str) -> Column:
    """A sum that skips nulls; nothing left to add gives 0."""
    return F.coalesce(F.sum(as_column(value)), F.lit(0))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """Division as double; a zero divisor gives null."""
    return F.try_divide(as_column(part).cast("double"), as_column(whole).cast("double"))


def percent(part: Column | str, whole: Column | str) -> Column:
    return ratio(part, whole) * 100


def round_even(value: Column | str, digits: int = 0) -> Column:
    """Rounding with halves to the even neighbour."""
    return F.bround(as_column(value), digits)


def to_number(value: Column | str, kind: str = "double") -> Column:
    """A number, or null where the text is not one."""
    return as_column(value).try_cast(kind)
