"""Files in and out: mixed headers, decimal commas, nested JSON, pages, GeoJSON, the report stream."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardwatch.functions.nulls import strict_sum
from wardwatch.plans import nightly, views
from wardwatch.sources import feeds, geo, pages, reports, sites, tables
from wardwatch.streaming.ingest import ingest_reports_stream

OLD = "bundesland,kreis,anzahl_standorte,anzahl_meldebereiche,betten_frei,betten_belegt,faelle_covid_aktuell,faelle_covid_aktuell_invasiv_beatmet,daten_stand"
NEW = '"","daten_stand","gemeindeschluessel","bundesland","betten_belegt","betten_frei","anzahl_standorte","anzahl_meldebereiche","faelle_covid_aktuell","faelle_covid_aktuell_beatmet","betten_frei_nur_erwachsen","betten_belegt_nur_erwachsen"'


def write_old(folder: Path):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "divi-intensivregister-2020-05-01-09-15.csv").write_text(f"{OLD}\n1,01001,2,3,5,7,1,NA,2020-05-01 09:15:00\n")


def write_new(folder: Path, free: int, suffix: str = ""):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [
        NEW,
        f'"1","2021-05-01 12:15:00","1001",1,8,{free},2,3,NA,1,4,NA',
        '"2","2021-05-01 12:15:00","02100",2,1,2,1,1,1,1,1,1',
        '"3","2021-05-01 12:15:00","02700",2,3,4,1,1,1,1,1,NA',
    ]
    (folder / f"divi-intensivregister-2021-05-01-12-15{suffix}.csv").write_text("\n".join(lines) + "\n")


def as_set(df):
    return {tuple(str(v) for v in row) for row in df.select(*sorted(df.columns)).collect()}


def test_reports_with_two_headers_are_read_by_name(spark, tmp_path):
    write_old(tmp_path / "in")
    write_new(tmp_path / "in", free=6)
    rows = {(str(r.date), r.gemeinde): r for r in reports.clean_reports(reports.read_daily_reports(spark, str(tmp_path / "in"))).collect()}
    assert set(rows) == {("2020-05-01", "01001"), ("2021-05-01", "01001"), ("2021-05-01", "02000")}
    old, new, merged = rows["2020-05-01", "01001"], rows["2021-05-01", "01001"], rows["2021-05-01", "02000"]
    assert (old.betten_frei, old.betten_belegt, old.faelle_covid_aktuell_beatmet, old.betten_frei_nur_erwachsen) == (5, 7, None, None)
    assert (new.betten_frei, new.betten_belegt, new.faelle_covid_aktuell) == (6, 8, None)
    assert (merged.betten_frei, merged.betten_belegt) == (6, 4)
    assert merged.betten_belegt_nur_erwachsen is None


def test_commas_and_quotes_inside_quotes(spark):
    files = [("f-2021-05-01-12-15.csv", 'betten_frei,kreis,daten_stand\r\n\r\n3,"a, ""b""",NA\n')]
    row = reports.parse_reports(spark.createDataFrame(files, "file string, value string")).collect()[0]
    assert (row.betten_frei, row.kreis, row.daten_stand, row.betten_belegt) == ("3", 'a, "b"', None, None)


def test_headers_without_a_mark_are_headers_and_files_without_one_fail(spark):
    def parse(*texts):
        files = [(f"f-2021-05-0{n}-12-15.csv", t) for n, t in enumerate(texts, 1)]
        return reports.parse_reports(spark.createDataFrame(files, "file string, value string"))

    rows = parse("kreis,betten_belegt\n01001,4\n", "kreis,betten_frei\nbetten_frei,5\n", "").collect()
    assert sorted((r.kreis, r.betten_belegt, r.betten_frei) for r in rows) == [("01001", "4", None), ("betten_frei", None, "5")]
    with pytest.raises(Exception, match="no header in"):
        parse("1,2\n3,4\n").collect()


def report_file(rows, quote=""):
    lines = ["kreis,bundesland,betten_frei,daten_stand"]
    for i in range(rows):
        stand = f"2021-05-01 12:{i % 60:02d}:00"
        field = f'"two\r\nlines ""{i}"", and\n\nmore"' if quote and i % 97 == 5 else stand
        lines.append(f"{i % 100000:05d},1,{i},{field}")
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("quoted", ["", "breaks"])
def test_large_files_are_read_by_several_tasks_with_the_same_rows(spark, tmp_path, quoted):
    (tmp_path / "divi-intensivregister-2021-05-01-12-15.csv").write_text(report_file(9000, quoted), newline="")
    (tmp_path / "divi-intensivregister-2021-05-02-12-15.csv").write_text("\n\r\n" + report_file(5000).replace("\n", "\r\n"), newline="")
    (tmp_path / "divi-intensivregister-2021-05-03-12-15.csv").write_text("kreis,betten_frei\n01001,7\n")
    whole = reports.read_daily_reports(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        lines = reports.large_report_lines(spark, str(tmp_path), 1000)
        assert lines.select("file", "block").distinct().count() > 15
        split = reports.read_daily_reports(spark, str(tmp_path), whole=1000)
        assert as_set(split) == as_set(whole) and split.count() == whole.count() == 14001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    if quoted:
        fields = {r.betten_frei: r.daten_stand for r in whole.collect() if r.file_name.endswith("05-01-12-15.csv")}
        assert fields["5"] == 'two\nlines "5", and\n\nmore' and len(fields) == 9000
    (tmp_path / "headless.csv").write_text("1,2\n" * 1000)
    with pytest.raises(Exception, match="no header in"):
        reports.read_daily_reports(spark, str(tmp_path), whole=1000).collect()


def test_a_stray_quote_costs_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('kreis,betten_frei\n01001,"7\n01002,8\n')
    for whole in (1 << 20, 1):
        rows = reports.read_daily_reports(spark, str(tmp_path), whole=whole).collect()
        assert len(rows) == 2 and "01002" in {r.kreis for r in rows}


def test_stream_equals_batch_on_the_same_folder(spark, tmp_path):
    """Re-uploads with and without a padded key, a file without a date, one without bed counts."""
    incoming, store = tmp_path / "incoming", str(tmp_path / "store")
    write_new(incoming, free=99)
    ingest_reports_stream(spark, str(incoming), store).awaitTermination()
    write_old(incoming)
    (incoming / "divi-intensivregister-2021-05-01-12-15-2.csv").write_text(
        "gemeindeschluessel,bundesland,betten_frei,daten_stand\n01001,1,6,2021-05-01 12:15:00\n")
    (incoming / "undated.csv").write_text("gemeindeschluessel,bundesland,betten_frei,daten_stand\n01002,1,3,NA\n")
    (incoming / "divi-intensivregister-2021-06-01-12-15.csv").write_text("kreis,bundesland,daten_stand\n01003,1,2021-06-01 12:15:00\n")
    ingest_reports_stream(spark, str(incoming), store).awaitTermination()
    stored = tables.read_table(spark, store, "icu_reports")
    batch = reports.clean_reports(reports.latest_reports(reports.read_daily_reports(spark, str(incoming))))
    assert as_set(stored) == as_set(batch)
    beds = {(str(r.date), r.gemeinde): r.betten_frei for r in batch.collect()}
    assert beds["2021-05-01", "01001"] == 6 and beds["None", "01002"] == 3 and beds["2021-06-01", "01003"] is None


def test_stream_in_two_drops_equals_batch_and_the_reupload_wins(spark, tmp_path):
    incoming, store = tmp_path / "incoming", str(tmp_path / "store")
    write_new(incoming, free=99)
    ingest_reports_stream(spark, str(incoming), store).awaitTermination()
    write_old(incoming)
    write_new(incoming, free=6, suffix="-2")
    ingest_reports_stream(spark, str(incoming), store).awaitTermination()
    ingest_reports_stream(spark, str(incoming), store).awaitTermination()  # nothing new
    plain = tmp_path / "plain"
    write_old(plain)
    write_new(plain, free=6)
    stored = tables.read_table(spark, store, "icu_reports")
    batch = reports.clean_reports(reports.read_daily_reports(spark, str(plain)))
    assert as_set(stored) == as_set(batch)


def test_file_names(spark):
    url = "https://h/a/b/c/d/2021-01-05_12-15_teilbare_divi_daten.csv?sequence=1"
    df = spark.createDataFrame([(url,), ("https://h/short",)], "u string")
    name, none = [r.n for r in df.select(reports.archive_file_name("u").alias("n")).collect()]
    assert name == "divi-intensivregister-2021-01-05-12-15.csv" and none is None
    stamps = spark.createDataFrame([(name,), (name[:-4] + "-2.csv",), ("other.csv",)], "f string")
    got = [r.s for r in stamps.select(reports.file_report_stamp("f").alias("s")).collect()]
    assert got == [dt.datetime(2021, 1, 5, 12, 15), dt.datetime(2021, 1, 5, 12, 15), None]


def test_decimal_commas(spark, tmp_path):
    text = "Datum" + "".join(f",v{n}" for n in range(9)) + "\n2021-05-01" + ',"1,5"' * 8 + ",NA\ntotal" + ",1" * 9 + "\n"
    (tmp_path / "r.csv").write_text(text)
    rows = feeds.read_decimal_comma_csv(spark, str(tmp_path / "r.csv")).collect()
    assert len(rows) == 1 and rows[0].PredictedNew == 1.5 and rows[0].R7d_High is None


def test_history_pages_merge_boroughs_and_pad_keys(spark, tmp_path):
    def attributes(key, total):
        return {"attributes": {"ObjectId": 1, "BundeslandId": 11, "AdmUnitId": key, "Datum": 86_400_000 * 18000,
                               "AnzFallNeu": 1, "AnzFallVortag": 0, "AnzFallErkrankung": 2, "AnzFallMeldung": 3, "KumFall": total}}

    for n, keys in enumerate((["11001", "1001"], ["11012"])):
        (tmp_path / f"{n}.json").write_text(json.dumps({"features": [attributes(k, 5 + n) for k in keys]}, indent=1))
    got = {r.gemeinde: (r.date, r.KumFall) for r in feeds.clean_history(feeds.read_paged_json(spark, str(tmp_path))).collect()}
    assert got == {"11000": (dt.date(2019, 4, 14), 11), "01001": (dt.date(2019, 4, 14), 5)}


def test_sites_with_and_without_units(spark):
    site = {"krankenhausStandort": {"id": "7", "plz": "19049", "position": {"latitude": 50.5, "longitude": 8.0}},
            "maxBettenStatusEinschaetzungLowCare": "BEGRENZT", "meldebereiche": [{"meldebereichId": "u1"}, {"meldebereichId": "u2"}]}
    bare = {"krankenhausStandort": {"id": "8", "plz": "1"}, "meldebereiche": []}
    df = sites.parse_sites(spark.createDataFrame([(json.dumps({"data": [site, bare]}),)], "value string"))
    flat = {r.id: r for r in sites.flatten_sites(df).collect()}
    assert flat["7"].latitude == 50.5 and flat["8"].latitude is None
    units = sorted((r.id, r.unitId) for r in sites.explode_units(df).collect() if r.unitId) + [
        (r.id, r.unitId) for r in sites.explode_units(df).collect() if r.unitId is None]
    assert units == [("7", "u1"), ("7", "u2"), ("8", None)]
    zips = spark.createDataFrame([("1", "01001")], "zipcode string, community_code string")
    located = {r.id: r for r in views.located_sites(sites.flatten_sites(df), zips).collect()}
    assert located["7"].community_code == "13004" and located["8"].community_code == "01001"
    assert located["7"].maxBettenStatusEinschaetzungLowCare == "Begrenzt"


def test_page_links(spark):
    html = '<link href="/style"><a class="x" href="/f/1.csv">a</a><a href="tel:030:1">b</a><a href="http://o/2.csv">c</a>'
    df = spark.createDataFrame([(1, html), (2, "<p>no links</p>")], "page_id long, html string")
    assert [(r.position, r.link) for r in pages.extract_links(df, ".csv", "http://h").collect()] == [
        (0, "http://h/f/1.csv"), (2, "http://o/2.csv")]
    assert [(r.page_id, r.link) for r in pages.first_link_per_page(df, "", "http://h").collect()] == [(1, "http://h/f/1.csv")]
    assert [r.tel for r in pages.extract_contact(df).collect()] == ["030", None]


def test_links_of_one_page_section(spark):
    html = ('<a href="/0">x</a><DIV Class="list ds-item"><div><a href="/1">a</a><br><img src="x"/></div><p><a class="y" href="/2">b</a></p></DIV>'
            '<a href="/3">c</a><!-- <div class="ds-item"><a href="/4">d</a> --><div id="t"><span class="ds-item"><a href="/5"></a></span><a href="/6">e</a>')
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    found = {s: [r.link for r in pages.extract_links(df, section=s).collect()] for s in (".ds-item", "#t", "p", ".ds", "#none")}
    assert found == {".ds-item": ["/1", "/2", "/5"], "#t": ["/5", "/6"], "p": ["/2"], ".ds": [], "#none": []}
    assert [(r.page_id, r.link) for r in pages.first_link_per_page(df, host="http://h", section=".ds-item").collect()] == [(1, "http://h/1")]


def test_only_new_csv_files(spark):
    offered = spark.createDataFrame([("a.csv",), ("b.csv",), ("c.pdf",)], "file_name string")
    stored = spark.createDataFrame([("a.csv",)], "file_name string")
    assert [r.file_name for r in reports.new_files_only(offered, stored).collect()] == ["b.csv"]


def test_geojson_parts_join_to_valid_json(spark, tmp_path):
    source = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"RS": k, "EWZ": 5}, "geometry": {"type": "Point", "coordinates": [n, 1]}}
        for n, k in enumerate(["01001", "99999", "01002"])]}
    (tmp_path / "in.geojson").write_text(json.dumps(source))
    measures = ", ".join(f"{m} double" for m in reports.REPORT_MEASURES)
    icu = spark.createDataFrame(
        [(dt.date(2021, 1, 1), "01001", *[9.0] * 8), (dt.date(2021, 1, 2), "01001", *[1.5] * 8), (dt.date(2021, 1, 2), "01002", *[None] * 8)],
        f"date date, gemeinde string, {measures}")
    enriched = geo.enrich_features(geo.read_features(spark, str(tmp_path / "in.geojson")), icu)
    geo.write_geojson(geo.feature_json(enriched), str(tmp_path / "out"))
    joined = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    result = json.loads(joined)["features"]
    assert [f["properties"]["RS"] for f in result] == ["01001", "99999", "01002"]
    assert result[0]["properties"]["betten_frei"] == 1.5 and result[0]["properties"]["EWZ"] == 5
    assert "betten_frei" not in result[1]["properties"] and result[2]["geometry"]["coordinates"] == [2, 1]


def test_nested_and_escaped_properties_come_out_as_they_went_in(spark, tmp_path):
    odd = {"RS": "01001", "name": 'a "quoted" \\ back\nslash é', "deep": {"list": [1, 2.5, None, {"x": []}], "flag": True}, "betten_frei": "old", "none": None}
    shape = {"type": "Polygon", "coordinates": [[[8.123456789012, 50], [9, -1e-7], [8.5, 49.25]]]}
    source = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": odd, "geometry": shape}, {"type": "Feature", "properties": {}, "geometry": None},
        {"type": "Feature", "properties": None, "geometry": {"type": "Point", "coordinates": []}}]}
    (tmp_path / "in.geojson").write_text(json.dumps(source))
    measures = ", ".join(f"{m} double" for m in reports.REPORT_MEASURES)
    icu = spark.createDataFrame([(dt.date(2021, 1, 2), "01001", 3.5, *[None] * 7)], f"date date, gemeinde string, {measures}")
    enriched = geo.enrich_features(geo.read_features(spark, str(tmp_path / "in.geojson")), icu)
    geo.write_geojson(geo.feature_json(enriched), str(tmp_path / "out"))
    found = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))["features"]
    known = reports.REPORT_MEASURES[0]
    assert found[0]["properties"] == (odd | {known: 3.5}) and found[0]["geometry"] == shape
    assert found[1] == {"type": "Feature", "properties": {}, "geometry": None}
    assert found[2] == {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": []}}


def test_two_collections_and_two_stamps_give_valid_json_and_one_feature_each(spark, tmp_path):
    for n in (1, 2):
        feature = {"type": "Feature", "properties": {"RS": "01001"}, "geometry": None}
        (tmp_path / f"{n}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}))
    measures = ", ".join(f"{m} double" for m in reports.REPORT_MEASURES)
    day = dt.date(2021, 1, 2)
    icu = spark.createDataFrame([(day, "01001", "09:00", *[1.0] * 8), (day, "01001", "12:00", *[2.0] * 8)],
                                f"date date, gemeinde string, daten_stand string, {measures}")
    enriched = geo.enrich_features(geo.read_features(spark, str(tmp_path / "*.geojson")), icu)
    geo.write_geojson(geo.feature_json(enriched), str(tmp_path / "out"))
    joined = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [f["properties"]["betten_frei"] for f in json.loads(joined)["features"]] == [2.0] * 4


def test_stored_tables_prune_months(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2021, m, 1), m) for m in range(1, 13)], "date date, v int")
    tables.write_table(df, str(tmp_path), "facts", month_of="date")
    back = tables.read_table(spark, str(tmp_path), "facts", since="2021-10")
    assert sorted(r.v for r in back.collect()) == [10, 11, 12]
    assert "month" in back._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_a_date_filter_prunes_months_and_the_newest_month_is_found(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2021, m, d), m) for m in range(1, 13) for d in (1, 20)], "date date, v int")
    tables.write_table(df, str(tmp_path), "facts", month_of="date", sort_by=("date",))
    back = tables.read_table(spark, str(tmp_path), "facts", days=("date", "2021-03-10", "2021-05-01"))
    assert sorted(r.v for r in back.collect()) == [3, 4, 4, 5]
    assert "month" in back._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert [r.v for r in tables.newest_month(spark, str(tmp_path), "facts").collect()] == [12, 12]


def rows_in(spark, root, name="facts"):
    return sorted((str(r.date), r.v) for r in tables.read_table(spark, str(root), name).collect())


def dated(spark, *rows):
    return spark.createDataFrame([(dt.date(2021, m, d), v) for m, d, v in rows], "date date, v int")


def test_changed_months_are_replaced_and_the_others_keep_their_files(spark, tmp_path):
    root = str(tmp_path)
    tables.write_table(dated(spark, (1, 1, 1), (2, 1, 2), (3, 1, 3)), root, "facts", month_of="date")
    before = tables.current(spark, root, "facts").parts
    tables.write_table(dated(spark, (2, 5, 20), (4, 1, 4)), root, "facts", month_of="date", changed_only=True)
    after = tables.current(spark, root, "facts").parts
    assert rows_in(spark, root) == [("2021-01-01", 1), ("2021-02-05", 20), ("2021-03-01", 3), ("2021-04-01", 4)]
    assert [m for m in before if after[m] != before[m]] == ["2021-02"] and set(after) - set(before) == {"2021-04"}
    tables.write_table(dated(spark, (7, 1, 7)), root, "facts", month_of="date")  # a whole version drops all other months
    assert rows_in(spark, root) == [("2021-07-01", 7)]
    undated = spark.createDataFrame([(None, 9)], "date date, v int")
    tables.write_table(undated, root, "facts", month_of="date", changed_only=True)
    assert rows_in(spark, root) == [("2021-07-01", 7), ("None", 9)]
    with pytest.raises(ValueError):
        tables.write_table(undated, root, "plain", changed_only=True)
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, root, "none")


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    tables.write_table(dated(spark, (1, 1, 1), (2, 1, 2)), root, "facts", month_of="date")
    held = tables.read_table(spark, root, "facts")  # a reader that began before
    broken = dated(spark, (1, 1, 10), (2, 1, 20)).withColumn("v", F.when(F.col("v") == 20, F.raise_error(F.lit("disk"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="disk"):
        tables.write_table(broken.repartition(2, "v"), root, "facts", month_of="date")
    assert rows_in(spark, root) == [("2021-01-01", 1), ("2021-02-01", 2)]
    (tmp_path / "facts" / "manifest" / "00000002.json").write_text('{"schema": {"type"')  # the writer died in its last step
    assert rows_in(spark, root) == [("2021-01-01", 1), ("2021-02-01", 2)]
    tables.write_table(dated(spark, (3, 1, 3)), root, "facts", month_of="date", changed_only=True)
    assert len(rows_in(spark, root)) == 3 and tables.current(spark, root, "facts").number == 3
    assert held.count() == 2  # its files are still there
    tables.write_table(dated(spark, (4, 1, 4)), root, "facts", month_of="date")
    tables.drop_old_versions(spark, root, "facts", keep=1)
    assert rows_in(spark, root) == [("2021-04-01", 4)]
    assert len([p for p in (tmp_path / "facts").iterdir() if p.name.startswith("version=")]) == 1


def test_a_writer_that_was_overtaken_builds_on_the_other_one(spark, tmp_path, monkeypatch):
    root, create, overtaken = str(tmp_path), tables.Folder.create, []
    tables.write_table(dated(spark, (1, 1, 1)), root, "facts", month_of="date")

    def late(folder, text, *parts):
        if not overtaken:
            overtaken.append(True)
            tables.write_table(dated(spark, (2, 1, 2)), root, "facts", month_of="date", changed_only=True)
        return create(folder, text, *parts)

    monkeypatch.setattr(tables.Folder, "create", late)
    tables.write_table(dated(spark, (3, 1, 3)), root, "facts", month_of="date", changed_only=True)
    assert [v for _, v in rows_in(spark, root)] == [1, 2, 3]


def test_the_last_date_comes_from_footers(spark, tmp_path):
    root = str(tmp_path)
    rows = dated(spark, *[(m, d, m * 100 + d) for m in range(1, 7) for d in (1, 9, 17)])
    tables.write_table(rows, root, "facts", month_of="date")
    newest = tables.footer_maximum(spark, root, "facts", "date")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(date)]" in plan and newest.collect()[0]["newest"] == dt.date(2021, 6, 17)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false" and "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    last = tables.newest_day(spark, root, "facts")
    assert [r.v for r in last.collect()] == [617] and len(last.inputFiles()) == 1
    tables.write_table(rows.limit(0), root, "empty", month_of="date")
    assert tables.newest_day(spark, root, "empty").count() == 0 and tables.newest_month(spark, root, "empty").count() == 0


def test_the_tenth_drop_reads_no_more_than_the_second(spark, tmp_path, monkeypatch):
    from wardwatch.streaming import ingest

    incoming, store, read = tmp_path / "incoming", str(tmp_path / "store"), []
    incoming.mkdir()
    original = ingest.kept_rows

    def counted(spark, store, months):
        kept = original(spark, store, months)
        read.append(0 if kept is None else len(kept.inputFiles()))
        return kept

    monkeypatch.setattr(ingest, "kept_rows", counted)
    for day in range(1, 11):
        for month in (1, 2 + day % 2):
            (incoming / f"divi-intensivregister-2021-{month:02d}-{day:02d}-12-15.csv").write_text(
                f"kreis,bundesland,betten_frei,daten_stand\n0100{day % 4},1,{day},2021-{month:02d}-{day:02d} 12:15:00\n")
        ingest_reports_stream(spark, str(incoming), store).awaitTermination()
    assert len(read) == 10 and max(read[2:]) <= 2 and read[9] == read[2]
    batch = reports.clean_reports(reports.latest_reports(reports.read_daily_reports(spark, str(incoming))))
    assert as_set(tables.read_table(spark, store, "icu_reports")) == as_set(batch) and batch.count() == 20


def test_nightly_tables_from_feeds(spark, tables, tmp_path):
    from catalog import standins as s
    from wardwatch.sources import tables as stored

    history, icu = s.case_history(tables), s.icu_daily(tables)
    nowcast = spark.createDataFrame([(dt.date(2021, 1, 1), 1.0)], "Date date, R7d double")
    nightly.store_cases(str(tmp_path), history, s.case_age(tables), s.vaccination(tables), nowcast)
    nightly.store_icu(str(tmp_path), icu)
    read = {n: stored.read_table(spark, str(tmp_path), n).count() for n in
            ("case_history", "case_age", "vaccination", "nowcast_r", "icu_daily", "county_names")}
    assert read["case_history"] == history.count() and read["icu_daily"] == icu.count() and read["county_names"] == icu.select("gemeinde").distinct().count()


def test_national_sum_is_the_sum_of_states_and_counties(spark, tables):
    from catalog import standins as s

    ages = s.case_age(tables)
    whole = ages.agg(strict_sum("cases").alias("n")).collect()[0].n
    assert whole == tables.orders.count()
    assert whole == sum(r["n"] for r in ages.groupBy("IdBundesland").agg(strict_sum("cases").alias("n")).collect())
