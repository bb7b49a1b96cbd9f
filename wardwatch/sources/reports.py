"""Daily report files: CSV whose header changes over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardwatch.functions.keys import HAMBURG_PARTS, merge_county_key, pad_report_key
from wardwatch.functions.nulls import as_column
from wardwatch.operators.aggregates import resum
from wardwatch.operators.clean import cast_many, fill_column
from wardwatch.operators.reshape import rbind
from wardwatch.session import settle

# The columns of the report feed.
REPORT_COLUMNS = [
    "bundesland",
    "gemeindeschluessel",
    "kreis",
    "anzahl_standorte",
    "anzahl_meldebereiche",
    "betten_frei",
    "betten_belegt",
    "betten_frei_nur_erwachsen",
    "betten_belegt_nur_erwachsen",
    "faelle_covid_aktuell",
    "faelle_covid_aktuell_beatmet",
    "faelle_covid_aktuell_invasiv_beatmet",
    "faelle_covid_aktuell_im_bundesland",
    "daten_stand",
]
REPORT_MEASURES = [
    "anzahl_standorte",
    "betten_frei",
    "betten_belegt",
    "anzahl_meldebereiche",
    "faelle_covid_aktuell",
    "faelle_covid_aktuell_beatmet",
    "betten_belegt_nur_erwachsen",
    "betten_frei_nur_erwachsen",
]
WHOLE_BYTES = 32 << 20
NEWLINE = r"\r?\n|\r"
BREAK = "\uE000"  # stands for a line break inside quotes
# Fixed value: how report files are named.
FILE_PREFIX = "divi-intensivregister-"


def file_report_stamp(file_name: Column | str) -> Column:
    """Report time in a file name such as ``...-2020-05-01-09-15.csv``; a ``-2`` before ``.csv`` marks a re-upload."""
    stamp = F.regexp_extract(as_column(file_name), r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2})(?:-2)?\.csv", 1)
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd-HH-mm"))


def latest_report_stamp(df: DataFrame, stamp: str = "daten_stand") -> DataFrame:
    """The newest report stamp of a batch, as it appears in file names."""
    newest = F.max(F.try_to_timestamp(F.substring(stamp, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))
    return df.agg(F.date_format(newest, "yyyy-MM-dd-HH-mm").alias("stamp"))


def read_report_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Report files, one row each: all counties of one day, a few dozen kilobytes. Files of over ``most`` bytes are left out."""
    files = spark.read.text(path, wholetext=True)
    if most is not None:
        files = files.where(F.col("_metadata.file_size") <= most)
    return files.select("value", F.col("_metadata.file_path").alias("file"))


def stream_report_files(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """As ``read_report_files``, for files that arrive over time."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )


def _fields(line: Column) -> Column:
    """Fields of a CSV line. Commas inside double quotes do not separate; ``NA`` and quotes go."""
    pieces = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    plain = F.transform(pieces, lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    return F.transform(plain, lambda x: F.nullif(F.replace(F.replace(x, F.lit('""'), F.lit('"')), F.lit(BREAK), F.lit("\n")), F.lit("NA")))


def _hide_breaks(text: Column) -> Column:
    """Line breaks inside double quotes as ``BREAK``. A text with an odd number of quotes stays as it is: one of them is stray."""
    parts = F.split(text, '"', -1)
    hidden = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, NEWLINE, BREAK)).otherwise(p))
    return F.when((F.size(parts) > 1) & (F.size(parts) % 2 == 1), F.array_join(hidden, '"')).otherwise(text)


def _named(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Check that ``_names``, the fields of the header, name at least one of the columns: no row is lost unseen."""
    missing = F.raise_error(F.concat(F.lit("no header in "), F.col("file"))).cast("array<string>")
    known = F.arrays_overlap("_names", F.array(*map(F.lit, columns)))
    return rows.withColumn("_names", F.when(known, F.col("_names")).otherwise(missing))


def _cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of lines ``value`` next to the ``_names`` of their file's header, with the file's date."""
    values = rows.withColumn("_values", _fields(F.col("value")))
    cells = {c: F.get("_values", F.array_position("_names", c).cast("int") - 1) for c in columns}
    name = F.regexp_extract("file", r"([^/=]*\d{4}-\d{2}-\d{2}-\d{2}-\d{2}(?:-2)?\.csv)", 1)
    return values.select(
        *[cell.alias(c) for c, cell in cells.items()],
        F.to_date(file_report_stamp(name)).alias("date"),
        name.alias("file_name"),
    )


def parse_reports(files: DataFrame, columns: list[str] = REPORT_COLUMNS) -> DataFrame:
    """All columns as text, matched by name to the header of the row's own file, plus the file's date.

    A file's header is its first line that is not blank. It must name at least one of the columns: a file without a
    header fails the query. Line breaks inside quotes belong to their field.
    """
    lines = F.filter(F.split(_hide_breaks(F.col("value")), NEWLINE), lambda line: F.trim(line) != "")
    split = files.select("file", lines.alias("_lines")).filter(F.size("_lines") > 0)
    headed = _named(split.withColumn("_names", _fields(F.get("_lines", F.lit(0)))), columns)
    rows = headed.select("file", "_names", F.explode(F.slice("_lines", F.lit(2), F.size("_lines"))).alias("value"))
    return _cells(rows, columns)


def large_report_lines(spark: SparkSession, path: str, least: int) -> DataFrame:
    """``file, block, at, value``: the lines of files of over ``least`` bytes, which Spark splits into blocks for several tasks.

    ``block`` and ``at`` order the lines of a file. In a file with an even number of quotes in all, lines that begin inside quotes are
    joined to the one that opened them. How many quotes lie before a block is a running sum over the file's
    blocks, so no task sees a whole file; only lines of such records move.
    """
    # Lines end at line feeds; a carriage return in front of one is cut off below, so that one inside quotes is part of the break.
    text = spark.read.option("lineSep", "\n").text(path).where(F.col("_metadata.file_size") > least)
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long")
    lines = text.select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    ).withColumn("quotes", quotes)
    odd = lines.where(F.col("quotes") % 2 == 1).groupBy("file").agg(F.count(F.lit(1)).alias("odd"))
    odd = settle(odd.where(F.col("odd") % 2 == 0).select("file"))
    if odd.isEmpty():
        return lines.drop("quotes")
    plain = lines.join(odd, "file", "left_anti")
    broken = settle(lines.join(odd, "file", "left_semi"))
    blocks = broken.groupBy("file", "block").agg(F.sum("quotes").alias("inside"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(blocks.withColumn("before", F.coalesce(F.sum("inside").over(earlier), F.lit(0))))
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("quotes").over(within), F.lit(0))
    seen = broken.join(starts.drop("inside"), ["file", "block"]).withColumn("opens", before % 2 == 0)
    seen = settle(seen.withColumn("record", F.max(F.when(F.col("opens"), F.col("at"))).over(within.rowsBetween(Window.unboundedPreceding, 0))))
    # A record that goes on in the next blocks: they carry the last line that opened one before them.
    last = seen.groupBy("file", "block").agg(F.max(F.when(F.col("opens"), F.col("at"))).alias("last"))
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    keyed = seen.join(carried, ["file", "block"]).withColumn("record", F.coalesce("record", "carried"))
    alone = (F.col("quotes") % 2 == 0) & F.col("opens")
    several = keyed.where(~alone).groupBy("file", "record").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    joined = several.select(F.array_join(F.transform("parts", lambda p: p["value"]), BREAK).alias("value"), "file", "block", F.col("record").alias("at"))
    return rbind(plain.drop("quotes"), keyed.where(alone).select("value", "file", "block", "at"), joined)


def read_large_reports(spark: SparkSession, path: str, least: int = 0, columns: list[str] = REPORT_COLUMNS) -> DataFrame:
    """As ``parse_reports``, for files of over ``least`` bytes: their lines are read by several tasks.

    The header of each file, one row, joins its lines by checked size.
    """
    lines = large_report_lines(spark, path, least).where(F.trim("value") != "")
    heads = lines.groupBy("file").agg(F.min(F.struct("block", "at")).alias("first"), F.min_by("value", F.struct("block", "at")).alias("head"))
    heads = _named(settle(heads.select("file", "first", _fields(F.col("head")).alias("_names"))), columns)
    rows = lines.join(heads, "file").where((F.col("block") != F.col("first.block")) | (F.col("at") != F.col("first.at")))
    return _cells(rows.select("file", "_names", "value"), columns)


def read_daily_reports(spark: SparkSession, path: str, whole: int = WHOLE_BYTES) -> DataFrame:
    """Files of up to ``whole`` bytes are read as one row each, so that a header needs no join; larger ones by several tasks."""
    small = parse_reports(read_report_files(spark, path, whole))
    if spark.read.text(path, wholetext=True).select(F.col("_metadata.file_size").alias("n")).where(F.col("n") > whole).isEmpty():
        return small
    return rbind(small, read_large_reports(spark, path, whole))


def clean_reports(raw: DataFrame) -> DataFrame:
    """One row per day, state, report stamp and county, from report rows that are all text."""
    df = raw.withColumn("gemeindeschluessel", pad_report_key("gemeindeschluessel"))
    df = fill_column(df, "gemeindeschluessel", "kreis").withColumnRenamed("gemeindeschluessel", "gemeinde")
    df = fill_column(df, "faelle_covid_aktuell_beatmet", "faelle_covid_aktuell_invasiv_beatmet")
    df = cast_many(df.drop("faelle_covid_aktuell_im_bundesland"), ["bundesland", *REPORT_MEASURES])
    df = df.withColumn("gemeinde", merge_county_key("gemeinde", HAMBURG_PARTS))
    return resum(df, ["date", "bundesland", "daten_stand", "gemeinde"], REPORT_MEASURES)


def latest_reports(raw: DataFrame) -> DataFrame:
    """Per day and county key the row of the latest report; a re-upload beats the first upload of its report.

    Batch and stream both take this step. Keys are compared as they are stored, padded, so ``5334`` and ``05334`` are one
    county. Files of the same day are versions of one report here, not parts to be added up.
    """
    name = F.col("file_name")
    order = F.struct(file_report_stamp(name), name.endswith("-2.csv"), name)
    key = F.coalesce(pad_report_key("gemeindeschluessel"), "kreis")
    newest = F.max_by(F.struct(*raw.columns), order).alias("_row")
    return raw.groupBy("date", key.alias("_key")).agg(newest).select("_row.*")


def write_raw_reports(df: DataFrame, path: str, report: str = "report", mode: str = "overwrite") -> None:
    """Store report rows as CSV with a header, one file per report.

    A report is one day of all counties, so it fits one task; the time goes into the number of files, which a
    fixed number of tasks shares (AQE would merge tasks by their few bytes).
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, 8)
    df.repartition(tasks, report).write.mode(mode).option("header", True).partitionBy(report).csv(path)


def new_files_only(offered: DataFrame, stored: DataFrame, column: str = "file_name") -> DataFrame:
    """CSV files on offer that are not stored yet."""
    return offered.filter(F.col(column).endswith(".csv")).join(stored.select(column), column, "left_anti")


def archive_file_name(url: Column | str) -> Column:
    """Local name for an archive link: its eighth part without query and label, first ``_`` as ``-``."""
    part = F.substring_index(F.get(F.split(as_column(url), "/"), F.lit(7)), "?", 1)
    part = F.regexp_replace(part, "^(.*?)_teilbare_divi_daten", "$1")
    return F.concat(F.lit(FILE_PREFIX), F.regexp_replace(part, "^([^_]*)_", "$1-"))

