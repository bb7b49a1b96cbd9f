"""Window measures per county. Frames of one county and order share one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from wardwatch.functions.nulls import as_column, percent, strict_sum_over


def per_series(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def new_from_cumulative(value: str, window: WindowSpec) -> Column:
    """Daily change of a running total; the first day counts in full."""
    return F.col(value) - F.lag(value, 1, 0).over(window)


def trailing_sum(value: Column | str, window: WindowSpec, rows: int = 7) -> Column:
    """Sum of the last ``rows`` rows, fewer at the start."""
    return strict_sum_over(value, window.rowsBetween(-(rows - 1), 0))


def trailing_sum_days(value: Column | str, keys: list[str], date: str, days: int = 7) -> Column:
    """Sum of the last ``days`` calendar days, however many rows they have."""
    window = Window.partitionBy(*keys).orderBy(F.unix_date(as_column(date)))
    return strict_sum_over(value, window.rangeBetween(-(days - 1), 0))


def cumulative(value: Column | str, window: WindowSpec) -> Column:
    """Running total; null from the first null on."""
    return strict_sum_over(value, window.rowsBetween(Window.unboundedPreceding, 0))


def fill_from_previous(value: str, window: WindowSpec) -> Column:
    """Where null, the original value one row before; two nulls in a row leave the second null."""
    return F.coalesce(F.col(value), F.lag(value).over(window))


def pct_change(value: str, window: WindowSpec) -> Column:
    """Change against the row before, in percent."""
    before = F.lag(value).over(window)
    return percent(F.col(value) - before, before)


def add_running_totals(df: DataFrame, keys: list[str], date: str, columns: dict[str, str]) -> DataFrame:
    """Running totals of ``columns`` (source to result name) per key by date."""
    window = per_series(keys, date)
    return df.withColumns({out: cumulative(c, window) for c, out in columns.items()})
