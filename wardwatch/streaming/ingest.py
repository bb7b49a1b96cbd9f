"""Incremental ingest of daily report files."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardwatch.operators.reshape import rbind
from wardwatch.sources import tables
from wardwatch.sources.reports import clean_reports, latest_reports, parse_reports, stream_report_files

LATEST, CLEANED = "latest_reports", "icu_reports"


def ingest_reports_stream(
    spark: SparkSession, incoming: str, store: str, files_per_batch: int = 10_000
) -> StreamingQuery:
    """Take in all report files that are new since the last run, then stop.

    The stream's checkpoint knows which files were seen. ``store`` holds two tables by month: ``latest_reports``, the latest report of
    each day and county as it came, and ``icu_reports``, the same cleaned. A later report of the same day and county wins.
    """
    files = stream_report_files(spark, incoming, files_per_batch)
    return (
        files.writeStream.foreachBatch(partial(_store_batch, store))
        .option("checkpointLocation", f"{store}/_progress")
        .trigger(availableNow=True)
        .start()
    )


def kept_rows(spark: SparkSession, store: str, months: list[str]) -> DataFrame | None:
    """The latest reports so far of some months: one row for each day and county, however many drops there were."""
    if tables.current(spark, store, LATEST) is None:
        return None
    return tables.stored_rows(spark, store, LATEST, months).drop("month")


def _store_batch(store: str, batch: DataFrame, batch_id: int) -> None:
    """Merge the batch into the latest reports of the months it touches, and clean these months again.

    Only those months are listed, read and replaced, so a run costs what its own months hold. The latest report of what was kept and what is
    new is the latest of all, so a batch may run again at any time, also when it died between its two tables. The touched months, one name
    for each, are known to the driver; rows of files whose name has no date form a month of their own.
    """
    spark = batch.sparkSession
    rows = parse_reports(batch)
    path = f"{store}/_batch"  # parsed once; the next batch takes its place
    rows.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    months = [r["month"] for r in rows.select(tables.month_name("date").alias("month")).distinct().collect()]
    if not months:
        return
    kept = kept_rows(spark, store, months)
    latest = latest_reports(rows if kept is None else rbind(kept, rows))
    tables.write_table(latest, store, LATEST, month_of="date", changed_only=True)
    cleaned = clean_reports(tables.stored_rows(spark, store, LATEST, months).drop("month"))
    tables.write_table(cleaned, store, CLEANED, month_of="date", changed_only=True)
