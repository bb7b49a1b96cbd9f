"""Both nightly jobs on a small set of raw files."""

import datetime as dt
import json

from wardwatch.forecast.models import ETS, LINEAR
from wardwatch.plans import views
from wardwatch.plans.jobs import Feeds, load_cases, load_county_forecasts, load_hospitals, load_icu
from wardwatch.sources.tables import read_table

DAYS = [dt.date(2021, 1, 1) + dt.timedelta(days=n) for n in range(80)]


def write_feeds(folder) -> Feeds:
    for name in ("history", "reports"):
        (folder / name).mkdir()
    (folder / "county.csv").write_text(
        "key,type,name,NUTS3,area,all,male,female,density\n"
        "01001,Kreis,A,DE1,10.5,1000,400,600,95\n11000,Stadt,Berlin,DE3,20,3000,1500,1500,150\n,,note,,,,,,\n"
    )
    rows = [
        {"attributes": {"ObjectId": 1, "BundeslandId": s, "AdmUnitId": k, "Datum": (d - dt.date(1970, 1, 1)).days * 86_400_000,
                        "AnzFallNeu": 1, "AnzFallVortag": 0, "AnzFallErkrankung": 1, "AnzFallMeldung": 1, "KumFall": n + 1}}
        for n, d in enumerate(DAYS) for s, k in ((1, "1001"), (11, "11001"), (11, "11002"), (0, "0"))
    ]
    (folder / "history" / "0.json").write_text(json.dumps({"features": rows}))
    (folder / "cases.csv").write_text(
        "a,b,c,d,e,f,g,h\n" + "".join(
            f'1,1001,A60-A79,2,1,{d} 00:00:00,{d:%Y/%m/%d} 00:00:00+00,"{d:%d.%m.%Y}, 00:00 Uhr"\n' for d in DAYS)
    )
    (folder / "doses.csv").write_text(
        "a,b,c,d,e\n" + "".join(f"{d},01001,{a},1,{n}\n" for n, d in enumerate(DAYS) for a in ("12-17", "60+") if n % 2 or a == "60+")
    )
    (folder / "nowcast.csv").write_text("Datum" + ",v" * 9 + "\n" + f"{DAYS[0]}" + ',"1,5"' * 9 + "\n")
    head = ("bundesland,gemeindeschluessel,anzahl_standorte,anzahl_meldebereiche,betten_frei,betten_belegt,"
            "betten_frei_nur_erwachsen,betten_belegt_nur_erwachsen,faelle_covid_aktuell,faelle_covid_aktuell_beatmet,daten_stand")
    for n, d in enumerate(DAYS):
        body = "".join(f"{s},{k},1,2,5,{10 + n},4,9,{n},{n // 2},{d} 12:15:00\n" for s, k in ((1, "1001"), (11, "11000")))
        (folder / "reports" / f"divi-intensivregister-{d}-12-15.csv").write_text(f"{head}\n{body}")
    (folder / "map.geojson").write_text(json.dumps({"features": [
        {"type": "Feature", "properties": {"RS": "01001"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    return Feeds(*(str(folder / n) for n in ("county.csv", "history", "cases.csv", "doses.csv", "nowcast.csv", "reports", "map.geojson")))


def test_both_jobs(spark, tmp_path):
    paths, root = write_feeds(tmp_path), str(tmp_path / "out")
    load_cases(spark, paths, root)
    load_icu(spark, paths, root, [ETS, LINEAR])
    history = {(r.gemeinde, r.date): r for r in read_table(spark, root, "case_history").collect()}
    assert len(history) == 3 * 80
    berlin = history["11000", DAYS[20]]
    assert (berlin.KumFall, berlin.FallNeu, berlin.Fall7d) == (42, 2, 14)
    assert abs(berlin.Incidence_7d_per_100k - 14 / 0.03) < 1e-9
    assert history["0", DAYS[20]].pop_all == 4000
    ages = read_table(spark, root, "case_age").collect()
    assert len(ages) == 80 and max(r.cumCases for r in ages) == 160
    assert read_table(spark, root, "vaccination").count() == 160
    icu = {(r.gemeinde, r.date): r for r in read_table(spark, root, "icu_daily").collect()}
    last = icu["01001", DAYS[-1]]
    assert (last.auslastung, last.covid_per_100k, last.Fall7d) == (94.7, 7900.0, 7)
    forecast = read_table(spark, root, "forecast").orderBy("date").collect()
    assert len(forecast) == 14 and forecast[0].date == DAYS[-1] + dt.timedelta(days=1)
    assert abs(forecast[0].value_sum_covid - 160) < 5
    assert [(r.sum_newCases, r.lockdown_level) for r in forecast] == [(3, 2)] * 14 and all(r.mean_7dIncidence is not None for r in forecast)
    assert read_table(spark, root, "forecast_accuracy").count() == 4
    load_county_forecasts(spark, root, [LINEAR])
    counties = read_table(spark, root, "county_forecast").collect()
    assert {r.series for r in counties} == {"01001", "11000"} and len(counties) == 28 and {r.sum_newCases for r in counties} == {1, 2}
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "map_geojson").glob("part-*")))
    assert json.loads(text)["features"][0]["properties"]["betten_belegt"] == 89.0
    card = views.county_stats(read_table(spark, root, "icu_daily"), read_table(spark, root, "case_history"), "01001").collect()
    assert "Einwohner: 1.000<br />" in card[0].card and "Betten(frei/gesamt): 5/94" in card[0].card


def test_hospital_job(spark, tmp_path):
    site = {"krankenhausStandort": {"id": "7", "plz": "1", "position": {"latitude": 50.5, "longitude": 8.0}},
            "maxBettenStatusEinschaetzungLowCare": "BEGRENZT", "meldebereiche": [{"meldebereichId": "u1"}, {"meldebereichId": "u2"}]}
    (tmp_path / "sites.json").write_text(json.dumps(site) + "\n" + json.dumps({"krankenhausStandort": {"id": "8", "plz": "9"}}))
    (tmp_path / "zips.csv").write_text("zipcode,community_code,line\n1,01001,1\n1,01002,2\n")
    section = {"bezeichnung": "ICU", "tags": ["a", "b"], "ansprechpartner": []}
    (tmp_path / "sections.json").write_text(
        json.dumps({"id": "7", "sections": [section, section | {"bezeichnung": "Covid"}]}) + "\n" + json.dumps({"id": "8", "sections": []}))
    load_hospitals(spark, str(tmp_path / "sites.json"), str(tmp_path / "zips.csv"), str(tmp_path / "out"), sections=str(tmp_path / "sections.json"))
    sites = {r.id: r for r in read_table(spark, str(tmp_path / "out"), "hospital_sites").collect()}
    assert (sites["7"].community_code, sites["7"].maxBettenStatusEinschaetzungLowCare) == ("01001", "Begrenzt")
    assert sites["8"].community_code is None
    sections = read_table(spark, str(tmp_path / "out"), "hospital_sections").collect()
    assert sorted((r.id, r.community_code, r.bezeichnung, len(r.tags)) for r in sections) == [("7", "01001", "Covid", 2), ("7", "01001", "ICU", 2)]
    units = read_table(spark, str(tmp_path / "out"), "hospital_units")
    assert sorted((r.id, r.unitId) for r in units.collect() if r.unitId) == [("7", "u1"), ("7", "u2")] and units.count() == 3
