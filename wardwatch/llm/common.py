"""Small helpers that several operators share."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardwatch.session import scratch_path

# Space, tab, line feed, vertical tab, form feed, carriage return; a word is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and go on from there.

    This cuts the lineage, survives lost executors, fixes row ids and partition numbers, and tells Spark the real
    size, so that later joins broadcast by checked size and split hot keys otherwise.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ranked(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Number all rows from 0 in a global order without one task seeing them all.

    Rows are dealt by range and numbered within each part; parts are counted, and the running count of the parts (one
    row for each partition) is added.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), label)
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    numbered = parts.withColumn("__at", inside).join(F.broadcast(starts), "__part")
    return numbered.withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__start", "__at")


def one_of_each(rows: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that win, one for each key. ``winners``: unique keys (null equals null) and ``copies``, their number of rows."""
    named = winners.withColumnsRenamed({k: f"__w_{k}" for k in keys})
    condition = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__w_{k}")) for k in keys))
    single = rows.join(named.where("copies = 1"), condition, "left_semi")
    several = named.where("copies > 1")
    if several.isEmpty():
        return single
    return single.unionByName(rows.join(several, condition, "left_semi").dropDuplicates(keys))
