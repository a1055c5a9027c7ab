"""Each rule on small scenes: one that fires and the ones that must not."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from aerolith.operators import rules

NOW = dt.datetime(2024, 5, 1, 12, 0, tzinfo=dt.timezone.utc)
SCHEMA = (
    "icao24 string, callsign string, lat double, lon double, altitude_ft int, heading_deg int, vertical_rate_fpm int, on_ground boolean, ts_polled timestamp, customer_region string, "
    "origin_icao string, destination_icao string, departure_time timestamp, nearest_site_icao string, nearest_site_distance_nm double, feed_last_ts timestamp"
)
AIRPORTS = [("KAAA", 40.0, -100.0), ("KBBB", 40.0, -90.0)]


def fix(minutes_ago, icao24="aaaaaa", **k):
    at = NOW - dt.timedelta(minutes=minutes_ago)
    row = dict(callsign="DAL1", lat=40.2, lon=-99.5, altitude_ft=28_000, heading_deg=90, vertical_rate_fpm=0, on_ground=False, customer_region="west", origin_icao=None, destination_icao=None, departure_time=None, nearest_site_icao="KAAA", nearest_site_distance_nm=20.0, feed_last_ts=None)
    return {"icao24": icao24, "ts_polled": at, **row, **k}


CLOCK = fix(0, "cccccc", altitude_ft=5_000)


@pytest.fixture
def run(spark):
    def go(rule, rows, conditions=(), cells=((0, 0),), **options):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        positions = spark.createDataFrame([tuple(r[n] for n in names) for r in [*rows, CLOCK]], SCHEMA)
        weather = spark.createDataFrame(list(conditions), "site_icao string, flight_category string, ceiling_ft int, visibility_sm double, wind_kt int")
        ctx = rules.Context(positions, weather, spark.createDataFrame(list(cells), "lat_cell int, lon_cell int"), spark.createDataFrame(AIRPORTS, "icao string, lat double, lon double"))
        found = rule.detect(ctx, **options).collect()
        return [(r, json.loads(r["detection_facts"])) for r in found if r["icao24"] != "cccccc"]

    return go


def test_lost_signal_fires_with_facts(run):
    ((row, facts),) = run(rules.LostSignal(), [fix(16), fix(25)])
    assert row["severity_hint"] == "high" and row["site_icao"] == "KAAA" and row["customer_region"] == "west"
    assert facts == {"callsign": "DAL1", "last_lat": 40.2, "last_lon": -99.5, "last_altitude_ft": 28_000, "last_seen": "2024-05-01T11:44:00Z", "gap_minutes": 16.0}


@pytest.mark.parametrize(
    "change",
    [
        {"altitude_ft": 24_999},
        {"on_ground": True},
        {"vertical_rate_fpm": -501},
        {"altitude_ft": 36_000},  # low is dropped
        {"feed_last_ts": NOW - dt.timedelta(minutes=2)},  # it only left the scope
        {"altitude_ft": None},
    ],
)
def test_lost_signal_stays_silent(run, change):
    assert run(rules.LostSignal(), [fix(16, **change)]) == []


@pytest.mark.parametrize("minutes, fires", [(13.9, False), (14, True), (30, True), (30.1, False)])
def test_lost_signal_gap(run, minutes, fires):
    assert bool(run(rules.LostSignal(), [fix(minutes)])) == fires


@pytest.mark.parametrize(
    "altitude, minutes, sparse, severity",
    [(29_999, 16, False, "high"), (30_000, 16, False, "medium"), (34_000, 16, True, None), (29_000, 16, True, "medium"), (34_000, 20, True, "medium"), (36_000, 20, False, "medium"), (29_000, 25, False, "high"), (36_000, 25, True, "medium")],
)
def test_lost_signal_severity(run, altitude, minutes, sparse, severity):
    found = run(rules.LostSignal(), [fix(minutes, altitude_ft=altitude, vertical_rate_fpm=None)], cells=[(40, -100)] if sparse else [(0, 0)])
    assert [r["severity_hint"] for r, _ in found] == ([severity] if severity else [])


def test_diversion(run):
    good = dict(on_ground=True, destination_icao="KBBB", origin_icao="KCCC", nearest_site_distance_nm=5.0)
    ((row, facts),) = run(rules.Diversion(), [fix(1, **good)])
    assert row["severity_hint"] == "high" and facts == {"callsign": "DAL1", "origin": "KCCC", "expected_destination": "KBBB", "alternate": "KAAA"}
    for change in ({"on_ground": False}, {"destination_icao": "KAAA"}, {"destination_icao": None}, {"nearest_site_distance_nm": 5.1}):
        assert run(rules.Diversion(), [fix(1, **{**good, **change})]) == []


def hold(n=10, step=4, **k):
    return [fix(i * step, altitude_ft=9_000, nearest_site_distance_nm=10.0, heading_deg=45 * i % 360, **k) for i in range(n)]


def test_excessive_hold(run):
    ((row, facts),) = run(rules.ExcessiveHold(), hold())
    assert row["severity_hint"] == "medium" and facts == {"callsign": "DAL1", "duration_minutes": 36.0, "distinct_heading_sectors": 8, "snapshots": 10}
    assert run(rules.ExcessiveHold(), hold(9)) == [] and run(rules.ExcessiveHold(), hold(step=3)) == []
    assert run(rules.ExcessiveHold(), hold(callsign="N12AB")) == []
    assert run(rules.ExcessiveHold(), [{**r, "heading_deg": 10} for r in hold()]) == []


def test_weather(run):
    found = run(rules.WeatherImpact(), [], [("KAAA", "LIFR", 200, 0.5, 9), ("KBBB", "IFR", 800, 2.0, 5), ("KCCC", "MVFR", 2000, 4.0, 3), ("KDDD", None, None, None, None)])
    assert sorted((r["site_icao"], r["severity_hint"], r["customer_region"], r["icao24"]) for r, _ in found) == [("KAAA", "high", "all", ""), ("KBBB", "medium", "all", "")]


def valley(*altitudes, **k):
    n = len(altitudes)
    return [fix((n - i) * 2, altitude_ft=a, nearest_site_distance_nm=4.0, **k) for i, a in enumerate(altitudes)]


def test_go_around(run):
    ((_, facts),) = run(rules.GoAround(), valley(4_000, 1_500, 3_000))
    assert facts == {"callsign": "DAL1", "min_altitude_ft": 1_500, "descent_ft": 2_500, "climb_ft": 1_500}
    for scene in ((1_500, 3_000, 4_000), (4_000, 3_000, 1_500), (4_000, 1_500, 2_400), (5_000, 3_100, 5_000), (4_000, 1_500)):
        assert run(rules.GoAround(), valley(*scene)) == []
    assert run(rules.GoAround(), valley(4_000, 1_500, 3_000, callsign="N1X")) == []


def test_delay(run):
    plan = dict(origin_icao="KAAA", destination_icao="KBBB")
    # 459 nm: 96.3 minutes expected, fires beyond 125.1
    late = fix(1, **plan, departure_time=NOW - dt.timedelta(minutes=130))
    ((row, facts),) = run(rules.Delay(), [late])
    assert row["site_icao"] == "KBBB" and facts["elapsed_minutes"] == 130.0 and 95 < facts["expected_minutes"] < 97
    for change in ({"departure_time": NOW - dt.timedelta(minutes=120)}, {"on_ground": True}, {"origin_icao": "KBBB"}, {"origin_icao": "KZZZ"}, {"departure_time": None}):
        assert run(rules.Delay(), [{**late, **change}]) == []


def anomalies(spark, *rows):
    return spark.createDataFrame([("go_around", i, s, "west", "{}", "medium") for i, s in rows], "rule string, icao24 string, site_icao string, customer_region string, detection_facts string, severity_hint string").withColumn("dedup_key", rules.GoAround().dedup_key("site_icao", "icao24", "detection_facts"))


def test_suppression(spark):
    found = anomalies(spark, ("a", "KAAA"), ("a", "KAAA"), ("b", None), ("c", "KAAA"), ("d", "KAAA"))
    assert rules.batch_dedup(found).count() == 4
    minutes = lambda n: NOW - dt.timedelta(minutes=n)
    cases = spark.createDataFrame(
        [("go_around", "a", "KAAA", "{}", "open", minutes(29)), ("go_around", "b", "", "{}", "open", minutes(5)), ("go_around", "c", "KAAA", "{}", "open", minutes(31)), ("go_around", "d", "KAAA", "{}", "resolved", minutes(5))],
        "case_type string, flight_id string, site_icao string, detection_facts string, status string, created_at timestamp",
    )
    left = rules.suppress_existing(found, cases, F.lit(NOW))
    assert sorted(r["icao24"] for r in left.collect()) == ["c", "d"]


def test_only_the_heuristic_baseline():
    with pytest.raises(ValueError):
        rules.baseline_provider("learned")


def test_nearest_site_by_list_and_by_cell(spark, monkeypatch):
    import random

    from aerolith.operators import joins

    rng = random.Random(5)
    sites = [(f"K{i:03d}", rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)] + [("KEAS", 10.0, 179.9), ("KWES", 10.0, -179.8), ("KPOL", 89.5, 20.0)]
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)]
    rows += [(900, 10.1, -179.93), (901, 10.1, 180.0), (902, 89.9, -160.0), (903, None, 1.0), (904, sites[0][1], sites[0][2])]
    s = spark.createDataFrame(sites, "icao string, lat double, lon double")
    p = spark.createDataFrame(rows, "i int, lat double, lon double")

    def nm(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 3440.065 * math.asin(math.sqrt(min(h, 1)))

    want = {i: (None, None) if a is None else min((round(nm(a, b, c, d), 6), icao) for icao, c, d in sites)[::-1] for i, a, b in rows}
    result = lambda: {r["i"]: (r["nearest_site_icao"], r["nearest_site_distance_nm"] if r["nearest_site_distance_nm"] is None else round(r["nearest_site_distance_nm"], 6)) for r in joins.nearest_site(p, s).collect()}
    assert result() == want
    monkeypatch.setattr(joins, "MAX_SITES", 25)
    assert result() == want
