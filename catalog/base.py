"""The registry of queries and the test tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


SCHEMAS: dict[str, StructType] = {}


class Tables:
    """The given tables of one folder, read on access. A file's schema is looked up once per process."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in SCHEMAS:
            SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(SCHEMAS[path]).parquet(path)


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    module: str


REGISTRY: dict[str, Query] = {}
CTES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under its own name, with its SQL twin if there is one."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        REGISTRY[build.__name__] = Query(
            lambda spark, folder: build(Tables(spark, folder)), None if sql is None else with_ctes(sql), build.__module__
        )
        return build

    return register


def half_even(value: str, digits: int) -> str:
    """SQL for half-even rounding of the shortest decimal text of a double, as Spark does it."""
    return f"CAST(round_even(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 16)), {digits}) AS DOUBLE)"


def with_ctes(sql: str) -> str:
    """Put the named sub-queries a text refers to, and those they refer to, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    heads = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in needed)
    if sql.lstrip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads},\n{sql.lstrip()[15:]}"
    if sql.lstrip().startswith("WITH "):
        return f"WITH {heads},\n{sql.lstrip()[5:]}"
    return f"WITH {heads}\n{sql}"
