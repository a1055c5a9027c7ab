"""Readers on small files, the lake, upserts and the archive sequence."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from aerolith.operators import joins, stores
from aerolith.plans.ingest import to_positions
from aerolith.sources import exports, lake, readers, upserts

UTC = dt.timezone.utc
NOW = dt.datetime(2024, 5, 1, 12, 30, tzinfo=UTC)


def vector(icao24="ABC123", **k):
    names = readers.STATE_FIELDS
    row = dict(zip(names, [icao24, "DAL12   ", "United States", 1714565000, 1714565010, -99.9, 40.1, 1000.0, False, 100.0, 89.6, -2.5, None, 1010.0, "", False, None]))
    row.update(k)
    return [row[n] for n in names]


@pytest.fixture
def files(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.write_text(text if isinstance(text, str) else json.dumps(text))
        return str(path)

    return put


def test_state_vectors(spark, files):
    path = files("states.json", {"time": 1714565020, "states": [vector(), vector("  "), vector()[:16], vector("def456", callsign="   ", lat=None, squawk="1200")]})
    rows = {r["icao24"]: r for r in readers.read_state_vectors(spark, path).collect()}
    assert set(rows) == {"abc123", "def456"}
    assert rows["abc123"]["callsign"] == "DAL12" and rows["abc123"]["squawk"] is None and rows["abc123"]["position_source"] == 0
    assert rows["def456"]["callsign"] is None and rows["def456"]["squawk"] == "1200" and rows["def456"]["lat"] is None
    prefixes = spark.createDataFrame([("de",)], "prefix string")
    sites = spark.createDataFrame([("KAAA", 40.0, -100.0, ["west", "east"])], "icao string, lat double, lon double, customer_regions array<string>")
    (p,) = to_positions(readers.read_state_vectors(spark, path), prefixes, sites).collect()
    assert (p["altitude_ft"], p["speed_kt"], p["heading_deg"], p["vertical_rate_fpm"], p["customer_region"]) == (3281, 194, 90, -492, "all")


def test_flight_history(spark, files):
    path = files("h.json", [{"icao24": "AB", "firstSeen": 10, "lastSeen": 20, "callsign": " X ", "estDepartureAirport": ""}, {"icao24": "cd", "firstSeen": 10}, {"firstSeen": 1, "lastSeen": 2}])
    (row,) = readers.read_flight_history(spark, path).collect()
    assert (row["icao24"], row["callsign"], row["origin_icao"], row["departure_candidates"]) == ("ab", "X", None, 0)


def test_weather(spark, files):
    metar = files("m.json", [{"icaoId": "kaaa", "rawOb": "raw", "obsTime": 1714565000, "wspd": 7, "wdir": "VRB", "visib": "10+", "temp": 12.5, "altim": 1013.2, "clouds": [{"cover": "FEW", "base": 300}, {"cover": "OVC", "base": 900}, {"cover": "BKN", "base": 700}]}, {"icaoId": "KBBB", "obsTime": 0, "wdir": 270, "visib": "M1/4", "clouds": []}])
    taf = files("t.json", [{"icaoId": "kaaa", "rawTAF": "TAF"}, {"icaoId": "KBBB", "rawTAF": " "}])
    rows = {r["site_icao"]: r for r in joins.conditions(readers.read_metar(spark, metar), readers.read_taf(spark, taf)).collect()}
    a, b = rows["KAAA"], rows["KBBB"]
    assert (a["wind_dir_deg"], a["visibility_sm"], a["ceiling_ft"], a["flight_category"], a["altimeter_in_hg"], a["taf_raw"]) == (None, 10.0, 700, "IFR", 29.92, "TAF")
    assert (b["observed_at"], b["wind_dir_deg"], b["visibility_sm"], b["ceiling_ft"], b["flight_category"], b["taf_raw"]) == (None, 270, None, None, None, None)


def test_reference_files(spark, files):
    watch = readers.read_watchlist(spark, files("w.json", {"airports": {"KAAA": {"customer_regions": ["west"]}, "KZZZ": {"customer_regions": []}}}))
    head = "ident,type,name,latitude_deg,longitude_deg,elevation_ft,iso_country,iso_region,municipality,scheduled_service,iata_code\n"
    lines = ["KAAA,large_airport, A ,40.5,-100,123,US,US-CA,Town,yes,AAA", "KBBB,medium_airport,B,41,-90,,US,US-NY,,yes,", "KCCC,small_airport,C,1,1,1,US,US-CA,,yes,", "KDDD,large_airport,D,1,1,1,CA,CA-ON,,yes,", "KEEE,large_airport,E,1,1,1,US,US-CA,,no,"]
    airports = readers.read_airports(spark, files("a.csv", head + "\n".join(lines)), watch)
    rows = {r["icao"]: r for r in airports.collect()}
    assert set(rows) == {"KAAA", "KBBB"}
    assert (rows["KAAA"]["state"], rows["KAAA"]["is_watched"], rows["KAAA"]["customer_regions"], rows["KAAA"]["elevation_ft"]) == ("CA", True, ["west"], 123)
    assert (rows["KBBB"]["iata"], rows["KBBB"]["is_watched"], rows["KBBB"]["customer_regions"]) == (None, False, [])
    assert [r["icao"] for r in joins.missing_sites(watch, airports).collect()] == ["KZZZ"]
    registry = readers.read_registry(spark, files("r.csv", "icao24,registration,typecode,model,operator,operatoricao\nABC,N1,B738,m,o,OO\nabc,N2,A320,m,o,OO\n,N3,,,,\ndef,N4,,,,\n"))
    assert {r["icao24"]: (r["registration"], r["type_code"]) for r in registry.collect()} == {"abc": ("N1", "B738"), "def": ("N4", None)}


def test_denylist(spark, files):
    good = readers.read_denylist(spark, files("d.txt", "# heading\nae\n\n 43c0 # note\n"))
    assert sorted(r["prefix"] for r in good.collect()) == ["43c0", "ae"]
    with pytest.raises(Exception, match="lower-case hex"):
        readers.read_denylist(spark, files("e.txt", "AE\n")).collect()


def position(spark, *rows):
    return spark.createDataFrame([(i, 40.0, -100.0, False, t) for i, t in rows], "icao24 string, lat double, lon double, on_ground boolean, ts_position timestamp")


def test_lake(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert lake.recent_positions(spark, root, 30, NOW).count() == 0
    for minutes in (95, 40, 20, 5):
        lake.write_positions(position(spark, ("a", NOW), ("b", None)), root, NOW - dt.timedelta(minutes=minutes))
    with pytest.raises(ValueError):
        lake.write_positions(position(spark).limit(0), root, NOW)
    recent = lake.recent_positions(spark, root, 30, NOW)
    assert recent.count() == 4 and lake.scan_positions(spark, root).count() == 8
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "ts_polled" in plan.split("PushedFilters: [")[1].split("]")[0]


def archive_rows(spark, *rows, at=NOW):
    return spark.createDataFrame([(i, "a", at, landed, at) for i, landed in rows], "flight_id string, icao24 string, takeoff_ts timestamp, landed_at timestamp, archived_at timestamp")


def test_archive(spark, tmp_path):
    root, days = str(tmp_path / "archive"), lambda n: NOW - dt.timedelta(days=n)
    assert lake.oldest_partition(spark, root) is None and stores.check_retention(spark, root, NOW.date())
    back = stores.archive_verify_delete(spark, archive_rows(spark, ("f1", days(40)), ("f2", days(2))), root, NOW)
    assert sorted(r["flight_id"] for r in back.collect()) == ["f1", "f2"]
    assert lake.archive_count(spark, root) == 2 and stores.check_rowcount(spark, root, NOW, 2)
    assert lake.read_flights_archive(spark, root, 10, NOW, ["flight_id"]).collect() == [("f2",)]
    assert lake.oldest_partition(spark, root) == days(40).date() and not stores.check_retention(spark, root, NOW.date())
    assert lake.purge_partitions(spark, root, days(30).date()) == [days(40).date()]
    assert lake.archive_count(spark, root) == 1 and lake.purge_partitions(spark, root, days(30).date()) == []
    with pytest.raises(Exception, match="null in one of"):
        lake.write_flights_archive(archive_rows(spark, ("f3", None)), str(tmp_path / "broken"))
    assert lake.read_archive_files(spark, [root, str(tmp_path / "absent")], ["flight_id"]).count() == 1
    assert lake.read_archive_files(spark, [str(tmp_path / "absent")]).count() == 0


def test_upserts(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    schema = "icao24 string, last_seen_at timestamp, callsign string, aircraft_type string"
    stored = spark.createDataFrame([("a", at(5), "old", None), ("b", at(5), "old", "B1"), ("c", at(5), "old", "C1")], schema)
    batch = spark.createDataFrame([("a", at(6), "new", "A2"), ("b", at(5), "tie", "B2"), ("c", at(4), "late", "C2"), ("d", at(1), "first", None)], schema)
    got = {r["icao24"]: (r["callsign"], r["aircraft_type"]) for r in upserts.upsert_positions(stored, batch).collect()}
    assert got == {"a": ("new", "A2"), "b": ("old", "B1"), "c": ("old", "C1"), "d": ("first", None)}
    path = upserts.replace_registry(stored, str(tmp_path / "registry"))
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        upserts.check_count(stored, 2)
    cases = stored.select(F.lit("c1").alias("case_id"), F.lit("{}").alias("detection_facts")).limit(1)
    upserts.append_cases(cases, str(tmp_path / "cases"), str(tmp_path / "timeline"), F.lit(NOW))
    assert spark.read.parquet(str(tmp_path / "timeline")).first()["event_type"] == "created"


def test_object_export(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, None, NOW)], "icao24 string, lat double, lon double, squawk string, last_seen_at timestamp")
    row = exports.export_objects(df, "aircraft").first()
    assert row["key"] == "a"
    assert json.loads(row["value"]) == {"aircraft": "a", "icao24": "a", "lat": 1.0, "lon": 2.0, "lastSeenAt": "2024-05-01T12:30:00Z", "position": '{"type":"Point","coordinates":[2.0,1.0]}'}


def test_nearest_site_with_many_sites_agrees_with_the_list(spark, monkeypatch):
    sites = spark.range(300).select(F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("icao"), (F.col("id") * 7 % 80 - 40).cast("double").alias("lat"), (F.col("id") * 13 % 170).cast("double").alias("lon"))
    positions = spark.range(200).select("id", ((F.col("id") * 31 % 900) / 10.0 - 45).alias("lat"), ((F.col("id") * 17 % 1700) / 10.0).alias("lon")).unionByName(spark.sql("select 999L as id, null as lat, 1.0D as lon"))
    rows = lambda: {r["id"]: (r["nearest_site_icao"], r["nearest_site_distance_nm"]) for r in joins.nearest_site(positions, sites).collect()}
    listed = rows()
    monkeypatch.setattr(joins, "MAX_SITES", 10)
    by_cell = rows()
    assert listed[999] == by_cell[999] == (None, None)
    assert all(abs(listed[k][1] - by_cell[k][1]) < 1e-9 for k in listed if k != 999)


def test_an_archive_run_that_is_started_again_leaves_each_flight_once(spark, tmp_path):
    days = lambda n: NOW - dt.timedelta(days=n)
    root, later = str(tmp_path / "archive"), NOW + dt.timedelta(minutes=15)
    rows = archive_rows(spark, ("f1", days(40)), ("f2", days(2)), ("f3", days(2)))
    for run_at, some in ((NOW, rows), (NOW, rows), (later, rows.filter("flight_id <> 'f1'"))):
        back = stores.archive_verify_delete(spark, some, root, run_at)
        assert sorted(r[0] for r in back.collect()) == sorted(r[0] for r in some.select("flight_id").collect())
    held = lake.read_flights_archive(spark, root)
    assert sorted((r["flight_id"], r["archived_at"] == r["archived_at"]) for r in held.collect()) == [("f1", True), ("f2", True), ("f3", True)]
    assert spark.read.parquet(root).count() == 5 and lake.archive_count(spark, root) == 3
    assert lake.archive_count_at(spark, root, NOW) == 3 and lake.archive_count_at(spark, root, later) == 2
    assert {r["flight_id"] for r in held.filter(F.col("archived_at") == F.lit(later).cast("timestamp")).collect()} == {"f2", "f3"}
