"""Stored tables: Parquet in versions, facts partitioned by month.

A table is a folder with one subfolder of files for each write and numbered manifests that name the folders which make up the
table, month by month. A write adds files and then the next manifest; until that is whole, and if the writer dies, readers
see the version before. A write may replace some months only; the others keep their files.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

WHOLE = ""  # stands for the month of a table without months
ATTEMPTS = 20  # of a writer that others overtake
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


class Manifest(NamedTuple):
    number: int
    schema: StructType  # of the rows, with the month if there are months
    monthly: bool
    parts: dict[str, str]  # month -> name of the write that holds it


class Folder:
    """The few file operations that manifests need, by the file system that Spark uses for the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.files = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def names(self, *parts: str) -> list[str]:
        path = self.at(*parts)
        return [s.getPath().getName() for s in self.files.listStatus(path)] if self.files.exists(path) else []

    def read(self, *parts: str) -> str:
        stream = self.files.open(self.at(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """Write a file under a name that is not taken; false if it is."""
        try:
            stream = self.files.create(self.at(*parts), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName() or "already exists" in str(error.java_exception):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def remove(self, *parts: str) -> None:
        self.files.delete(self.at(*parts), True)


def manifest_of(text: str, number: int) -> Manifest | None:
    """None for a manifest whose writer died: it does not end as it should."""
    try:
        held = json.loads(text)
    except ValueError:
        return None
    return Manifest(number, StructType.fromJson(held["schema"]), held["monthly"], held["parts"])


def manifests(folder: Folder) -> list[int]:
    return sorted((int(n.removesuffix(".json")) for n in folder.names("manifest") if n.endswith(".json") and not n.startswith(".")), reverse=True)


def current(spark: SparkSession, root: str, name: str) -> Manifest | None:
    """The newest whole manifest."""
    folder = Folder(spark, f"{root}/{name}")
    for number in manifests(folder):
        if (found := manifest_of(folder.read("manifest", f"{number:08d}.json"), number)) is not None:
            return found
    return None


def _publish(spark: SparkSession, root: str, name: str, schema: StructType, monthly: bool, version: str, written: list[str], keep: bool) -> None:
    """Put the next manifest in place. With ``keep``, months that were not written stay as whoever was first left them."""
    folder = Folder(spark, f"{root}/{name}")
    for _ in range(ATTEMPTS):
        taken = manifests(folder)
        before = current(spark, root, name) if keep else None
        parts = (before.parts if before else {}) | dict.fromkeys(written, version)
        text = json.dumps({"schema": schema.jsonValue(), "monthly": monthly, "parts": parts})
        if folder.create(text, "manifest", f"{(taken[0] if taken else 0) + 1:08d}.json"):
            return
    raise RuntimeError(f"other writers of {root}/{name} were first {ATTEMPTS} times")


def write_table(
    df: DataFrame, root: str, name: str, month_of: str | None = None, sort_by: tuple[str, ...] = (), changed_only: bool = False
) -> None:
    """Write the next version of a stored table; ``month_of`` names the date column whose month partitions a fact table.

    The rebalance hint gives each month whole files and lets AQE split a month that is too big for one task. Rows are
    sorted by ``sort_by`` within a file, so that a filter on it skips most of the file's row groups. With
    ``changed_only`` the months that occur in ``df`` are replaced and the table's other months stay. Rows without a date form a
    month of their own.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    path = f"{root}/{name}/version={version}"
    if month_of is None:
        if changed_only:
            raise ValueError("a table without months is replaced as a whole")
        df.write.parquet(path)
        _publish(spark, root, name, df.schema, False, version, [WHOLE], keep=False)
        return
    monthly = df.withColumn("month", month_name(month_of))
    sorted_rows = monthly.hint("rebalance", "month").sortWithinPartitions("month", *sort_by)
    sorted_rows.write.partitionBy("month").parquet(path)
    months = [n.removeprefix("month=") for n in Folder(spark, path).names() if n.startswith("month=")]  # one name for each month
    _publish(spark, root, name, monthly.schema, True, version, months, keep=changed_only)


def month_name(date: str):
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("undated"))


def stored_rows(spark: SparkSession, root: str, name: str, months: list[str] | None = None) -> DataFrame:
    """The rows of the current version, with ``month`` if it has months; only folders of ``months``, if given, are listed."""
    found = current(spark, root, name)
    if found is None:
        raise FileNotFoundError(f"no table {name} in {root}")
    base = f"{root}/{name}"
    paths = [
        f"{base}/version={version}" + (f"/month={month}" if found.monthly else "")
        for month, version in found.parts.items() if months is None or month in months
    ]
    if not paths:
        return spark.createDataFrame([], found.schema)
    schema = StructType([f for f in found.schema]).add("version", "string")
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).drop("version")


def read_table(
    spark: SparkSession, root: str, name: str, since: str | None = None, days: tuple[str, str, str] | None = None
) -> DataFrame:
    """A stored table; ``since`` (``yyyy-MM``) skips the month partitions before it.

    ``days`` is a date column with the first and last day wanted; only the month partitions between them are read.
    """
    df = stored_rows(spark, root, name)
    if since is not None:
        df = df.filter(F.col("month") >= since)
    if days is not None:
        column, first, last = days
        df = df.filter(F.col("month").between(first[:7], last[:7]) & F.col(column).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return df.drop("month")


def newest_month(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a fact table's last month, which the manifest names."""
    found = current(spark, root, name)
    dated = [m for m in found.parts if m != "undated"] if found else []
    return stored_rows(spark, root, name, [max(dated)] if dated else []).drop("month")


def footer_maximum(spark: SparkSession, root: str, name: str, column: str) -> DataFrame:
    """The largest value of a column as one row ``newest``, from the statistics in the files' footers: no column is read.

    The aggregate is pushed into the scan when the frame is made; the session's settings are as before afterwards.
    """
    before = {key: spark.conf.get(key, None) for key in FOOTERS}
    for key, value in FOOTERS.items():
        spark.conf.set(key, value)
    try:
        newest = stored_rows(spark, root, name).agg(F.max(column).alias("newest"))
        newest._jdf.queryExecution().optimizedPlan()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return newest


def newest_day(spark: SparkSession, root: str, name: str, column: str = "date") -> DataFrame:
    """The rows of a fact table's last date. The date comes from footers, so that one month's files are read."""
    last = footer_maximum(spark, root, name, column).collect()[0]["newest"]
    if last is None:
        return stored_rows(spark, root, name, []).drop("month")
    return stored_rows(spark, root, name, [f"{last:%Y-%m}"]).filter(F.col(column) == F.lit(last)).drop("month")


def drop_old_versions(spark: SparkSession, root: str, name: str, keep: int = 2) -> None:
    """Remove the manifests before the last ``keep`` whole ones, and files that none of these names.

    Not while a writer is at work: its files are named by no manifest yet.
    """
    folder = Folder(spark, f"{root}/{name}")
    held = [(n, manifest_of(folder.read("manifest", f"{n:08d}.json"), n)) for n in manifests(folder)]
    kept = [m for _, m in held if m is not None][:keep]
    used = {version for m in kept for version in m.parts.values()}
    for number, _ in held:
        if kept and number < kept[-1].number:
            folder.remove("manifest", f"{number:08d}.json")
    for entry in folder.names():
        if entry.startswith("version=") and entry.removeprefix("version=") not in used:
            folder.remove(entry)
