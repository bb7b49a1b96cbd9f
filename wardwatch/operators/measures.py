"""Bed and incidence measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardwatch.functions.nulls import as_column, percent, ratio, round_even


def occupancy(occupied: Column | str, free: Column | str) -> Column:
    """Occupied beds in percent of all beds, one digit."""
    return round_even(percent(occupied, as_column(free) + as_column(occupied)), 1)


def covid_share(covid: Column | str, occupied: Column | str) -> Column:
    """Covid patients in percent of occupied beds, one digit."""
    return round_even(percent(covid, occupied), 1)


def incidence(count: Column | str, population: Column | str) -> Column:
    """Count per 100,000 people, not rounded."""
    return ratio(count, ratio(population, F.lit(100000.0)))


def per_100k(count: Column | str, population: Column | str) -> Column:
    """Count per 100,000 people, whole number."""
    return round_even(incidence(count, population), 0)

