"""Regional keys: padding and mergers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardwatch.functions.nulls import as_column

# Official county keys that the feeds report in parts or under a former key.
BERLIN_BOROUGHS = {
    "11000": [
        "11001", "11002", "11003", "11004", "11005", "11006", "11007", "11008", "11009", "11010", "11011", "11012",
    ]
}
BAVARIAN_MERGERS = {"09463": ["09473"], "09563": ["09573"]}
HAMBURG_PARTS = {"02000": ["02100", "02200", "02300", "02400", "02500", "02600", "02700"]}


def pad_county_key(key: Column | str) -> Column:
    """Give four-character keys their leading zero back; other lengths, such as "0" for the nation, stay."""
    key = as_column(key)
    return F.when(F.length(key) == 4, F.concat(F.lit("0"), key)).otherwise(key)


def pad_report_key(key: Column | str) -> Column:
    """As ``pad_county_key``, but keys that already start with a zero stay."""
    key = as_column(key)
    return F.when((F.length(key) == 4) & ~key.startswith("0"), F.concat(F.lit("0"), key)).otherwise(key)


def merge_county_key(key: Column | str, *mergers: dict[str, list[str]]) -> Column:
    """Replace former keys by the key of the county they now belong to."""
    key = as_column(key)
    merged = key
    for merger in mergers:
        for target, former in merger.items():
            merged = F.when(key.isin(former), F.lit(target)).otherwise(merged)
    return merged
