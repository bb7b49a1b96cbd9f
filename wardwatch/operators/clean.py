"""Column cleaning: renames, casts, keys, fills, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardwatch.functions.nulls import as_column, to_number

# Availability codes and their labels, in display order.
STATUS_LABELS = [
    ("VERFUEGBAR", "Verfügbar"),
    ("BEGRENZT", "Begrenzt"),
    ("NICHT_VERFUEGBAR", "Nicht verfügbar"),
    ("KEINE_ANGABE", "Keine Angabe"),
]
# Postcodes whose county is set by hand.
COUNTY_OF_ZIP = {"19049": "13004", "59870": "05958", "95693": "03355", "99437": "16071"}
# Names of the 16 states by their number.
STATE_NAMES = [
    "Schleswig-Holstein",
    "Hamburg",
    "Niedersachsen",
    "Bremen",
    "Nordrhein-Westfalen",
    "Hessen",
    "Rheinland-Pfalz",
    "Baden-Württemberg",
    "Bayern",
    "Saarland",
    "Berlin",
    "Brandenburg",
    "Mecklenburg-Vorpommern",
    "Sachsen",
    "Sachsen-Anhalt",
    "Thüringen",
]


def rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename every column by position."""
    return df.toDF(*names)


def relocate(df: DataFrame, *front: str) -> DataFrame:
    """Move columns to the front, keeping the order of the rest."""
    return df.select(*front, *[c for c in df.columns if c not in front])


def cast_many(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Cast a set of columns; text that does not fit becomes null."""
    return df.withColumns({c: to_number(c, kind) for c in columns})


def fill_column(df: DataFrame, column: str, fallback: str) -> DataFrame:
    """Take ``fallback`` where ``column`` is null, then drop the fallback."""
    return df.withColumn(column, F.coalesce(column, fallback)).drop(fallback)


def lookup(value: Column | str, table: dict[str, str]) -> Column:
    """The table's text for a value, null for unknown values."""
    value = as_column(value)
    found = F.lit(None).cast("string")
    for key, text in table.items():
        found = F.when(value == key, F.lit(text)).otherwise(found)
    return found


def relabel_status(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace availability codes by labels and add ``<column>_rank`` for the display order."""
    labels = dict(STATUS_LABELS)
    ranks = {code: str(n) for n, (code, _) in enumerate(STATUS_LABELS, start=1)}
    return df.withColumns(
        {f"{c}_rank": lookup(c, ranks).cast("int") for c in columns}
        | {c: lookup(c, labels) for c in columns}
    )


def override_by_key(df: DataFrame, key: str, column: str, values: dict[str, str]) -> DataFrame:
    """Set ``column`` by hand for a few keys, keep it elsewhere."""
    return df.withColumn(column, F.coalesce(lookup(key, values), F.col(column)))


def state_name(state: Column | str) -> Column:
    """Name of a state by its number from 1 to 16; null outside."""
    names = F.array(*[F.lit(n) for n in STATE_NAMES])
    return F.get(names, as_column(state).cast("int") - 1)


def name_key_map(df: DataFrame, name: str = "name", key: str = "gemeinde") -> DataFrame:
    """Entries of a county picker: label and value."""
    return df.select(F.col(name).alias("label"), F.col(key).alias("value")).distinct()
