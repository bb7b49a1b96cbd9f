"""The feeds of the library, derived from the given tables, in Spark and in SQL.

Orders stand for cases, line items for ICU reports, events for vaccinations, suppliers for hospital sites.
Nation 9 stands for two counties, nation 2 and nation 11 report in parts, nation 0 is the whole nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalog.base import CTES, Tables, half_even
from wardwatch.functions.keys import (
    BAVARIAN_MERGERS,
    BERLIN_BOROUGHS,
    HAMBURG_PARTS,
    merge_county_key,
    pad_county_key,
    pad_report_key,
)
from wardwatch.operators.aggregates import distinct_first, national_total_row, resum
from wardwatch.operators.windows import cumulative, per_series
from wardwatch.plans import nightly
from wardwatch.sources.feeds import HISTORY_MEASURES
from wardwatch.sources.reports import REPORT_MEASURES

AGES = ["click", "error", "purchase", "signup", "view"]
DAY_MS = 86_400_000


def plain_key(nation: Column) -> Column:
    return (nation * 1000).cast("string")


def county_key(nation: Column, number: Column) -> Column:
    """The up-to-date county of a row."""
    split = F.when(number % 2 == 0, F.lit("09463")).otherwise(F.lit("09563"))
    return F.when(nation == 9, split).otherwise(pad_county_key(plain_key(nation)))


def case_key(nation: Column, number: Column) -> Column:
    """The county as the case feed writes it: without leading zero, by borough, under former keys."""
    former = F.element_at(
        F.array(*[F.lit(k) for k in ("9463", "9563", "9473", "9573")]), (number % 4 + 1).cast("int")
    )
    borough = F.concat(F.lit("110"), F.lpad((number % 12 + 1).cast("string"), 2, "0"))
    return F.when(nation == 9, former).when(nation == 11, borough).otherwise(plain_key(nation))


def report_key(nation: Column, number: Column) -> Column:
    """The county as the report feed writes it: without leading zero, one county in seven parts."""
    split = F.when(number % 2 == 0, F.lit("9463")).otherwise(F.lit("9563"))
    part = F.concat(F.lit("02"), (number % 7 + 1).cast("string"), F.lit("00"))
    return F.when(nation == 9, split).when(nation == 2, part).otherwise(plain_key(nation))


_SQL_COUNTY = """CASE WHEN {n} = 9 THEN CASE WHEN {i} % 2 = 0 THEN '09463' ELSE '09563' END
    WHEN {n} BETWEEN 1 AND 9 THEN '0' || CAST({n} * 1000 AS VARCHAR) ELSE CAST({n} * 1000 AS VARCHAR) END"""


COUNTY_OF_0 = "25000"


def sql_county(nation: str, number: str) -> str:
    return _SQL_COUNTY.format(n=nation, i=number)


# --- dimensions ---------------------------------------------------------------------------------


def county(t: Tables) -> DataFrame:
    """Counties with their people, from customers. In the facts the number 0 stands for the nation; its customers are a county of their own."""
    key = F.when(F.col("c_nationkey") == 0, F.lit(COUNTY_OF_0)).otherwise(county_key(F.col("c_nationkey"), F.col("c_custkey")))
    people = t.customer.select(key.alias("key"), "c_nationkey", "c_custkey")
    counts = people.groupBy("key").agg(
        F.max("c_nationkey").alias("nation"),
        F.count(F.lit(1)).alias("pop_all"),
        F.count_if(F.col("c_custkey") % 2 == 0).alias("pop_male"),
        F.count_if(F.col("c_custkey") % 2 == 1).alias("pop_female"),
    )
    named = counts.join(t.nation, counts["nation"] == F.col("n_nationkey"))
    area = (F.col("nation") + 1).cast("double")
    return named.select(
        "key",
        F.lit("Kreis").alias("type"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("DE"), "key").alias("NUTS3"),
        area.alias("area"),
        "pop_all",
        "pop_male",
        "pop_female",
        (F.col("pop_all") / area).alias("pop_per_km2"),
    )


def county_and_nation(t: Tables) -> DataFrame:
    return national_total_row(county(t))


CTES["county"] = f"""
  SELECT key, 'Kreis' AS type, n_name AS name, 'DE' || key AS NUTS3, CAST(nation + 1 AS DOUBLE) AS area,
         pop_all, pop_male, pop_female, pop_all / CAST(nation + 1 AS DOUBLE) AS pop_per_km2
  FROM (SELECT CASE WHEN c_nationkey = 0 THEN '{COUNTY_OF_0}' ELSE {sql_county('c_nationkey', 'c_custkey')} END AS key, max(c_nationkey) AS nation,
               count(*) AS pop_all, count(*) FILTER (WHERE c_custkey % 2 = 0) AS pop_male,
               count(*) FILTER (WHERE c_custkey % 2 = 1) AS pop_female
        FROM customer GROUP BY 1) c
  JOIN nation ON n_nationkey = c.nation"""
CTES["county_and_nation"] = """
  SELECT '0' AS key, 'Land' AS type, 'Deutschland' AS name, 'DE' AS NUTS3, sum(area) AS area,
         CAST(sum(pop_all) AS BIGINT) AS pop_all, CAST(sum(pop_male) AS BIGINT) AS pop_male,
         CAST(sum(pop_female) AS BIGINT) AS pop_female, sum(pop_all) / sum(area) AS pop_per_km2 FROM county
  UNION ALL SELECT * FROM county"""


def zip_rows(t: Tables) -> DataFrame:
    """Postcode rows with repeated postcodes."""
    return t.customer.select(
        (F.col("c_custkey") % 1000 + 10000).cast("string").alias("zipcode"),
        county_key(F.col("c_nationkey"), F.col("c_custkey")).alias("community_code"),
        F.col("c_custkey").alias("line"),
    )


def zips(t: Tables) -> DataFrame:
    return distinct_first(zip_rows(t), "zipcode", ["line"])


CTES["zips"] = f"""
  SELECT zipcode, community_code, line FROM (
    SELECT CAST(c_custkey % 1000 + 10000 AS VARCHAR) AS zipcode,
           {sql_county('c_nationkey', 'c_custkey')} AS community_code, c_custkey AS line
    FROM customer)
  QUALIFY row_number() OVER (PARTITION BY zipcode ORDER BY line) = 1"""


# --- cases --------------------------------------------------------------------------------------


def case_events(t: Tables) -> DataFrame:
    """One row per case with its place and day."""
    placed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    placed = placed.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.select(
        F.col("n_regionkey").alias("state"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_custkey").alias("number"),
        F.to_date("o_orderdate").alias("date"),
        F.col("c_mktsegment").alias("age"),
        F.col("o_orderstatus").alias("status"),
    )


CTES["case_events"] = """
  SELECT n_regionkey AS state, c_nationkey AS nation, c_custkey AS number, CAST(o_orderdate AS DATE) AS date,
         c_mktsegment AS age, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def case_days(t: Tables) -> DataFrame:
    """The days of all cases, from one column."""
    return t.orders.select(F.to_date("o_orderdate").alias("date"))


def history_daily(t: Tables) -> DataFrame:
    """Cleaned history: one row per county and day with counts and the running total."""
    daily = case_events(t).groupBy(
        county_key(F.col("nation"), F.col("number")).alias("gemeinde"),
        "date",
        F.col("state").alias("BundeslandId"),
    ).agg(
        F.count_if(F.col("status") == "P").alias("AnzFallNeu"),
        F.count_if(F.col("status") == "O").alias("AnzFallVortag"),
        F.count(F.lit(1)).alias("AnzFallErkrankung"),
        F.count_if(F.col("status") == "F").alias("AnzFallMeldung"),
    )
    return daily.withColumn("KumFall", cumulative("AnzFallErkrankung", per_series(["gemeinde"], "date")))


def history_attributes(t: Tables) -> DataFrame:
    """The same as the history feed sends it: keys without leading zero, one county in two boroughs."""
    daily = history_daily(t)
    parts = daily.withColumn(
        "part", F.explode(F.when(F.col("gemeinde") == "11000", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    half = {m: F.floor(F.col(m) / 2) for m in HISTORY_MEASURES}
    shared = {
        m: F.when(F.col("gemeinde") != "11000", F.col(m))
        .when(F.col("part") == 0, half[m])
        .otherwise(F.col(m) - half[m])
        for m in HISTORY_MEASURES
    }
    raw_key = F.when(F.col("gemeinde") == "11000", F.concat(F.lit("1100"), (F.col("part") + 1).cast("string")))
    raw_key = raw_key.otherwise(F.regexp_replace("gemeinde", "^0(?=.)", ""))
    return parts.select(
        F.lit(None).cast("long").alias("ObjectId"),
        "BundeslandId",
        raw_key.alias("AdmUnitId"),
        (F.unix_date("date").cast("long") * DAY_MS).alias("Datum"),
        *[v.cast("long").alias(m) for m, v in shared.items()],
    )


def case_history(t: Tables) -> DataFrame:
    return nightly.case_history(history_daily(t), county_and_nation(t))


CTES["history_daily"] = f"""
  SELECT *, CAST(sum(AnzFallErkrankung) OVER (PARTITION BY gemeinde ORDER BY date) AS BIGINT) AS KumFall
  FROM (SELECT {sql_county('nation', 'number')} AS gemeinde, date, state AS BundeslandId,
               count(*) FILTER (WHERE status = 'P') AS AnzFallNeu,
               count(*) FILTER (WHERE status = 'O') AS AnzFallVortag,
               count(*) AS AnzFallErkrankung,
               count(*) FILTER (WHERE status = 'F') AS AnzFallMeldung
        FROM case_events GROUP BY 1, 2, 3)"""
CTES["case_history"] = """
  SELECT s.*, type, name, NUTS3, area, pop_all, pop_male, pop_female, pop_per_km2,
         Fall7d / (pop_all / 100000.0::DOUBLE) AS Incidence_7d_per_100k
  FROM (SELECT *, CAST(sum(FallNeu) OVER (PARTITION BY gemeinde ORDER BY date
                       ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS Fall7d
        FROM (SELECT *, KumFall - lag(KumFall, 1, 0) OVER (PARTITION BY gemeinde ORDER BY date) AS FallNeu
              FROM history_daily)) s
  LEFT JOIN county_and_nation ON key = gemeinde"""


def case_rows(t: Tables) -> DataFrame:
    """The case feed by age, keys brought up to date."""
    raw = case_events(t).withColumn("raw", case_key(F.col("nation"), F.col("number")))
    return raw.select(
        F.col("state").alias("IdBundesland"),
        merge_county_key(pad_county_key("raw"), BERLIN_BOROUGHS, BAVARIAN_MERGERS).alias("IdLandkreis"),
        F.col("age").alias("Altersgruppe"),
        F.lit(1).cast("long").alias("AnzahlFall"),
        (F.col("status") == "F").cast("long").alias("AnzahlTodesfall"),
        F.col("date").alias("Refdatum"),
    )


def case_age(t: Tables) -> DataFrame:
    return nightly.case_age(case_rows(t))


CTES["age_daily"] = f"""
  SELECT state AS IdBundesland, {sql_county('nation', 'number')} AS IdLandkreis, date AS Refdatum,
         age AS Altersgruppe, count(*) AS cases, count(*) FILTER (WHERE status = 'F') AS deaths
  FROM case_events GROUP BY 1, 2, 3, 4"""
CTES["case_age"] = """
  SELECT *, CAST(sum(cases) OVER w AS BIGINT) AS cumCases, CAST(sum(deaths) OVER w AS BIGINT) AS cumDeaths
  FROM age_daily WINDOW w AS (PARTITION BY IdBundesland, IdLandkreis, Altersgruppe ORDER BY Refdatum)"""


# --- ICU reports --------------------------------------------------------------------------------


def icu_reports(t: Tables) -> DataFrame:
    """Report rows as the feed sends them: unpadded keys, one county in parts, some figures missing."""
    placed = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    placed = placed.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    closed, covid = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
    quantity = F.col("l_quantity")

    def beds(condition: Column) -> Column:
        return F.sum(F.when(condition, quantity).otherwise(0.0))

    def reported(value: Column, step: int) -> Column:
        number = F.unix_date("date") * 7 + F.col("nation") * 3
        return F.when(number % step != 0, value)

    rows = placed.select(
        F.to_date("l_shipdate").alias("date"),
        F.nullif("n_regionkey", F.lit(0)).cast("double").alias("bundesland"),
        F.col("s_nationkey").alias("nation"),
        report_key(F.col("s_nationkey"), F.col("s_suppkey")).alias("gemeindeschluessel"),
        "l_quantity", "l_linestatus", "l_returnflag", "l_discount", "l_linenumber",
    )
    daily = rows.groupBy("date", "bundesland", "nation", "gemeindeschluessel").agg(
        F.count(F.lit(1)).cast("double").alias("anzahl_standorte"),
        F.sum("l_linenumber").cast("double").alias("anzahl_meldebereiche"),
        beds(~closed).alias("betten_frei"),
        beds(closed).alias("betten_belegt"),
        F.sum(F.when(~closed & (F.col("l_returnflag") == "A"), quantity)).alias("betten_frei_nur_erwachsen"),
        F.sum(F.when(closed & (F.col("l_returnflag") != "N"), quantity)).alias("betten_belegt_nur_erwachsen"),
        beds(closed & covid).alias("_covid"),
        beds(closed & covid & (F.col("l_discount") > 0.05)).alias("_intub"),
    )
    return daily.select(
        "date",
        "bundesland",
        "gemeindeschluessel",
        F.concat(F.col("date").cast("string"), F.lit(" 12:15:00")).alias("daten_stand"),
        "anzahl_standorte", "anzahl_meldebereiche", "betten_frei", "betten_belegt",
        "betten_frei_nur_erwachsen", "betten_belegt_nur_erwachsen",
        reported(F.col("_covid"), 97).alias("faelle_covid_aktuell"),
        reported(F.col("_intub"), 101).alias("faelle_covid_aktuell_beatmet"),
    )


def report_days(t: Tables) -> DataFrame:
    """The days of all reports, from one column."""
    return t.lineitem.select(F.to_date("l_shipdate").alias("date"))


def icu_clean(t: Tables) -> DataFrame:
    """Reports with merged keys, summed again."""
    raw = icu_reports(t)
    key = merge_county_key(pad_report_key("gemeindeschluessel"), HAMBURG_PARTS)
    keyed = raw.withColumn("gemeinde", key).drop("gemeindeschluessel")
    return resum(keyed, ["date", "bundesland", "daten_stand", "gemeinde"], REPORT_MEASURES)


def icu_metrics(t: Tables) -> DataFrame:
    return nightly.icu_metrics(icu_clean(t), county(t))


def icu_daily(t: Tables) -> DataFrame:
    return nightly.icu_daily(icu_clean(t), county(t), case_history(t))


_STEP = "((date - DATE '1970-01-01') * 7 + nation * 3)"
CTES["icu_reports"] = f"""
  SELECT date, bundesland, nation, part, CAST(date AS VARCHAR) || ' 12:15:00' AS daten_stand,
         anzahl_standorte, anzahl_meldebereiche, betten_frei, betten_belegt,
         betten_frei_nur_erwachsen, betten_belegt_nur_erwachsen,
         CASE WHEN {_STEP} % 97 <> 0 THEN covid END AS faelle_covid_aktuell,
         CASE WHEN {_STEP} % 101 <> 0 THEN intub END AS faelle_covid_aktuell_beatmet
  FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(nullif(n_regionkey, 0) AS DOUBLE) AS bundesland,
               s_nationkey AS nation,
               CASE WHEN s_nationkey = 9 THEN s_suppkey % 2 WHEN s_nationkey = 2 THEN s_suppkey % 7 ELSE 0 END AS part,
               CAST(count(*) AS DOUBLE) AS anzahl_standorte,
               CAST(sum(l_linenumber) AS DOUBLE) AS anzahl_meldebereiche,
               sum(CASE WHEN l_linestatus <> 'F' THEN l_quantity ELSE 0 END) AS betten_frei,
               sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS betten_belegt,
               sum(CASE WHEN l_linestatus <> 'F' AND l_returnflag = 'A' THEN l_quantity END) AS betten_frei_nur_erwachsen,
               sum(CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN l_quantity END) AS betten_belegt_nur_erwachsen,
               sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS covid,
               sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_discount > 0.05::DOUBLE
                        THEN l_quantity ELSE 0 END) AS intub
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2, 3, 4)"""


def sql_strict(*columns: str) -> str:
    """SQL for sums that are null as soon as one input is null."""
    return ", ".join(f"CASE WHEN count({c}) = count(*) THEN sum({c}) END AS {c}" for c in columns)


CTES["icu_clean"] = f"""
  SELECT date, bundesland, daten_stand, gemeinde, {sql_strict(*REPORT_MEASURES)}
  FROM (SELECT *, {sql_county('nation', 'part')} AS gemeinde FROM icu_reports)
  GROUP BY 1, 2, 3, 4"""
CTES["icu_metrics"] = f"""
  SELECT i.*, type, name, NUTS3, area, pop_all, pop_male, pop_female, pop_per_km2,
         {half_even('betten_belegt / nullif(betten_frei + betten_belegt, 0) * 100', 1)} AS auslastung,
         {half_even('faelle_covid_aktuell / nullif(betten_belegt, 0) * 100', 1)} AS pct_covid,
         {half_even('faelle_covid_aktuell / (pop_all / 100000.0::DOUBLE)', 0)} AS covid_per_100k,
         {half_even('faelle_covid_aktuell_beatmet / (pop_all / 100000.0::DOUBLE)', 0)} AS covid_per_100k_intubated
  FROM icu_clean i LEFT JOIN county ON key = gemeinde"""
CTES["icu_daily"] = """
  SELECT m.*, BundeslandId, AnzFallNeu, AnzFallVortag, AnzFallErkrankung, AnzFallMeldung, KumFall, Fall7d,
         Incidence_7d_per_100k
  FROM icu_metrics m LEFT JOIN case_history h ON m.date = h.date AND m.gemeinde = h.gemeinde"""


# --- vaccinations -------------------------------------------------------------------------------


def vaccination_rows(t: Tables) -> DataFrame:
    nation = F.col("user_id") % 25
    return t.events.groupBy(
        F.to_date("ts").alias("date"),
        county_key(nation, F.col("user_id")).alias("IdLandkreis"),
        (F.get_json_object("props", "$.k").cast("int") % 3 + 1).alias("vcCount"),
        F.col("event_type").alias("Altersgruppe"),
    ).agg(F.count(F.lit(1)).alias("count"))


def vaccination(t: Tables) -> DataFrame:
    return nightly.vaccination(vaccination_rows(t))


CTES["vaccination_rows"] = f"""
  SELECT CAST(ts AS DATE) AS date, {sql_county('(user_id % 25)', 'user_id')} AS IdLandkreis,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 + 1 AS vcCount,
         event_type AS Altersgruppe, count(*) AS count
  FROM events GROUP BY 1, 2, 3, 4"""
CTES["vaccination_dense"] = """
  SELECT k.*, a.Altersgruppe, coalesce(v.count, 0) AS count
  FROM (SELECT DISTINCT date, IdLandkreis, vcCount FROM vaccination_rows) k
  CROSS JOIN (SELECT DISTINCT event_type AS Altersgruppe FROM events) a
  LEFT JOIN vaccination_rows v USING (date, IdLandkreis, vcCount, Altersgruppe)"""
CTES["vaccination"] = """
  SELECT *, CAST(sum(count) OVER (PARTITION BY IdLandkreis, Altersgruppe, vcCount ORDER BY date) AS BIGINT)
            AS cum_count
  FROM vaccination_dense"""


# --- hospital sites -----------------------------------------------------------------------------


def status_code(value: Column) -> Column:
    return (
        F.when(value < 0, "NICHT_VERFUEGBAR").when(value < 3000, "BEGRENZT").when(value < 8000, "VERFUEGBAR")
        .when(value < 9000, "KEINE_ANGABE").otherwise("UNBEKANNT")
    )


def sites(t: Tables) -> DataFrame:
    """Nested site rows as the registry sends them; every third site has no units."""
    number, money = F.col("s_suppkey"), F.col("s_acctbal")
    by_hand = F.when(number % 25 == 3, "19049").when(number % 25 == 4, "59870")
    place = F.struct(
        number.cast("string").alias("id"),
        F.col("s_name").alias("bezeichnung"),
        F.lit("Hauptstr.").alias("strasse"),
        (number % 90 + 1).cast("string").alias("hausnummer"),
        by_hand.otherwise((number * 7 % 1100 + 10000).cast("string")).alias("plz"),
        F.concat(F.lit("Ort "), F.col("s_nationkey").cast("string")).alias("ort"),
        F.col("s_nationkey").cast("string").alias("bundesland"),
        F.concat(F.lit("IK-"), number.cast("string")).alias("ikNummer"),
        F.struct(
            (F.lit(47.0) + number * 37 % 800 / 100).alias("latitude"),
            (F.lit(6.0) + number * 53 % 900 / 100).alias("longitude"),
        ).alias("position"),
    )
    unit = F.struct(
        F.concat(number.cast("string"), F.lit("-1")).alias("meldebereichId"),
        F.lit("Intensiv").alias("meldebereichBezeichnung"),
        F.when(money > 0, "true").otherwise("false").alias("ardsNetzwerkMitglied"),
    )
    return t.supplier.select(
        place.alias("krankenhausStandort"),
        F.lit("2021-05-01T12:00:00Z").alias("letzteMeldezeitpunkt"),
        status_code(money).alias("maxBettenStatusEinschaetzungLowCare"),
        status_code(money + 1000).alias("maxBettenStatusEinschaetzungHighCare"),
        status_code(money - 2000).alias("maxBettenStatusEinschaetzungEcmo"),
        F.filter(F.array(unit), lambda x: number % 3 != 0).alias("meldebereiche"),
    )


def sections(t: Tables) -> DataFrame:
    """Sections of sites: one per turn of a conversation."""
    turn = F.col("turn").cast("string")
    return t.conversations.select(
        F.col("conv_id").cast("string").alias("id"),
        F.concat("role", F.lit(" "), turn).alias("bezeichnung"),
        F.lit("2021-05-01").alias("letzteMeldung"),
        F.col("role").alias("behandlungsschwerpunktL1"),
        F.lit(None).cast("string").alias("behandlungsschwerpunktL2"),
        F.array("role", turn).alias("ansprechpartner"),
        F.split("text", " ", -1).alias("tags"),
    )


def _sql_status(value: str) -> str:
    return (
        f"CASE WHEN {value} < 0 THEN 'NICHT_VERFUEGBAR' WHEN {value} < 3000 THEN 'BEGRENZT' "
        f"WHEN {value} < 8000 THEN 'VERFUEGBAR' WHEN {value} < 9000 THEN 'KEINE_ANGABE' ELSE 'UNBEKANNT' END"
    )


CTES["sites_flat"] = f"""
  SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS bezeichnung, 'Hauptstr.' AS strasse,
         CAST(s_suppkey % 90 + 1 AS VARCHAR) AS hausnummer,
         CASE WHEN s_suppkey % 25 = 3 THEN '19049' WHEN s_suppkey % 25 = 4 THEN '59870'
              ELSE CAST(s_suppkey * 7 % 1100 + 10000 AS VARCHAR) END AS plz,
         'Ort ' || CAST(s_nationkey AS VARCHAR) AS ort, CAST(s_nationkey AS VARCHAR) AS bundesland,
         'IK-' || CAST(s_suppkey AS VARCHAR) AS ikNummer,
         CAST(47 AS DOUBLE) + CAST(s_suppkey * 37 % 800 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
         CAST(6 AS DOUBLE) + CAST(s_suppkey * 53 % 900 AS DOUBLE) / CAST(100 AS DOUBLE) AS longitude,
         '2021-05-01T12:00:00Z' AS letzteMeldezeitpunkt,
         {_sql_status('s_acctbal')} AS maxBettenStatusEinschaetzungLowCare,
         {_sql_status('(s_acctbal + 1000)')} AS maxBettenStatusEinschaetzungHighCare,
         {_sql_status('(s_acctbal - 2000)')} AS maxBettenStatusEinschaetzungEcmo
  FROM supplier"""


def _sql_label(column: str) -> str:
    return (
        f"CASE {column} WHEN 'VERFUEGBAR' THEN 'Verfügbar' WHEN 'BEGRENZT' THEN 'Begrenzt' "
        f"WHEN 'NICHT_VERFUEGBAR' THEN 'Nicht verfügbar' WHEN 'KEINE_ANGABE' THEN 'Keine Angabe' END"
    )


def _sql_rank(column: str) -> str:
    return (
        f"CASE {column} WHEN 'VERFUEGBAR' THEN 1 WHEN 'BEGRENZT' THEN 2 "
        f"WHEN 'NICHT_VERFUEGBAR' THEN 3 WHEN 'KEINE_ANGABE' THEN 4 END"
    )


CTES["sites_located"] = f"""
  SELECT s.* EXCLUDE (maxBettenStatusEinschaetzungLowCare, maxBettenStatusEinschaetzungHighCare,
                      maxBettenStatusEinschaetzungEcmo),
         CASE plz WHEN '19049' THEN '13004' WHEN '59870' THEN '05958' WHEN '95693' THEN '03355'
                  WHEN '99437' THEN '16071' ELSE community_code END AS community_code,
         {', '.join(f'{_sql_label(c)} AS {c}, CAST({_sql_rank(c)} AS INTEGER) AS {c}_rank' for c in (
             'maxBettenStatusEinschaetzungLowCare', 'maxBettenStatusEinschaetzungHighCare',
             'maxBettenStatusEinschaetzungEcmo'))}
  FROM sites_flat s LEFT JOIN zips ON zipcode = plz"""


# --- map features -------------------------------------------------------------------------------


def features(t: Tables) -> DataFrame:
    """One map feature per nation; the last one has no county."""
    number = F.col("n_nationkey")
    key = F.when(number == 24, F.lit("99999")).otherwise(county_key(number, F.lit(0)))
    bag = F.struct(key.alias("RS"), (number + 1).alias("EWZ"))
    shape = F.concat(F.lit('{"type":"Point","coordinates":['), number.cast("string"), F.lit(",50]}"))
    return t.nation.select(number.alias("position"), F.to_json(bag).alias("properties"), shape.alias("geometry"))


CTES["features"] = f"""
  SELECT n_nationkey AS position,
         CASE WHEN n_nationkey = 24 THEN '99999' ELSE {sql_county('n_nationkey', '0')} END AS RS
  FROM nation"""
