"""Scalar rules on edge values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.functions import scalars as sc


def column(spark, schema, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {schema}")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_weather_values(spark):
    assert column(spark, "string", ["10+", "3", "2.5", "M1/4", None, ""], sc.parse_visibility) == [10.0, 3.0, 2.5, None, None, None]
    pairs = spark.createDataFrame([(499, 10.0), (500, 10.0), (999, None), (1000, 6.0), (3000, 5.0), (None, 5.1), (None, 0.9), (None, None), (5000, 2.9)], "c int, v double")
    assert [r[0] for r in pairs.select(sc.flight_category("c", "v")).collect()] == ["LIFR", "IFR", "IFR", "MVFR", "MVFR", "VFR", "LIFR", None, "IFR"]


def test_small_values(spark):
    assert column(spark, "array<string>", [None, [], ["west"], ["west", "east"]], sc.collapse_region) == [None, None, "west", "all"]
    assert column(spark, "string", ["N1A", "N", "NA1", "DAL1", None], sc.is_ga) == [True, False, False, False, False]
    assert column(spark, "double", [0.5, 1.5, -2.5, None], sc.to_int) == [0, 2, -2, None]
    assert column(spark, "int", [0, 44, 45, 359, 360, -10], geo.heading_sector) == [0, 0, 1, 7, 0, 7]
    assert column(spark, "double", [-71.2, 71.9], geo.cell) == [-72, 71]
    assert column(spark, "string", ["a-1700000000", "a-b-17", "x", "-5", "a-"], lambda c: sc.parse_flight_key(c)["icao24"]) == ["a", "a-b", None, None, None]
    assert column(spark, "array<string>", [[" ABCDEF ", "abcdef", "xyz", "12345"]], sc.normalise_ids) == [["abcdef"]]
    assert column(spark, "string", ["a, b,, c ", None], sc.split_refs) == [["a", "b", "c"], []]
    assert column(spark, "string", ["[Auto] x\n call \n\n tower", None], sc.manual_steps) == [["call", "tower"], []]
    assert column(spark, "string", ["US-CA", "US-", None], sc.state_of) == ["CA", None, None]
    assert column(spark, "string", ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+0200", "2024-01-01T01:00:00+01:00", " ", "soon"], lambda c: sc.epoch(sc.to_utc(c)))[:1] == [1704067200]
    assert column(spark, "string", ['{"a":1,"b":null,"c":{"d":1},"e":[1],"f":"x","g":true}'], sc.scalar_facts) == [{"a": "1", "f": "x", "g": "true"}]
    assert column(spark, "string", ["west", None], sc.region_title) == ["West", None]
    with pytest.raises(Exception, match="unknown region"):
        column(spark, "string", ["north"], sc.region_title)
    assert column(spark, "string", ["abc", None], lambda c: sc.case_url(F.lit("https://x/"), c)) == ["https://x/lightning/r/Case/abc/view", None]


def test_staleness_and_status(spark):
    now = dt.datetime(2024, 1, 1, 1)
    ages = [dt.datetime(2024, 1, 1, 1) - dt.timedelta(seconds=s) for s in (59, 60, 299, 300)]
    assert column(spark, "timestamp", ages, lambda c: sc.staleness(c, F.lit(now))) == ["fresh", "stale", "stale", "lost"]
    timelines = [[("departed", now), ("landed", now)], [("climb", now)], []]
    kind = "array<struct<stage:string,occurred_at:timestamp>>"
    assert column(spark, kind, timelines, sc.flight_status) == ["landed", "enroute", "unknown"]
    assert column(spark, kind, timelines, sc.landed_at)[1:] == [None, None]


def test_shapes(spark):
    kind = "array<struct<lat:double,lon:double>>"
    lines = column(spark, kind, [[(1.0, 2.0), (1.0, 2.0), (3.0, 4.0)], [(1.0, 2.0), (1.0, 2.0)], None], geo.line)
    assert lines[0]["coordinates"] == [[2.0, 1.0], [4.0, 3.0]] and lines[1] is None and lines[2] is None
    (nm,) = column(spark, "double", [40.0], lambda c: geo.haversine(c, F.lit(-100.0), F.lit(40.0), F.lit(-90.0)))
    assert abs(nm - 459.6) < 0.5


def test_scopes(spark):
    df = spark.createDataFrame([("west",), ("east",), ("all",), (None,)], "customer_region string")
    got = lambda d: sorted(str(r[0]) for r in d.collect())
    assert got(sc.scope_positions(df, "west")) == ["None", "west"]
    assert got(sc.scope_positions(df, "all", "east")) == ["None", "east"]
    with pytest.raises(PermissionError):
        sc.scope_positions(df, "west", "east")
    assert got(sc.scope_cases(df, "west")) == ["all", "west"]
    assert got(sc.scope_flights(df, "west")) == ["None", "all", "west"]
    assert got(sc.in_live_scope(df, ["west"])) == ["west"]
    with pytest.raises(ValueError):
        geo.in_bbox(df, 10, 0, 0, 1)


def test_case_ids_count_on_in_order(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 100).alias("k"))
    rows = sc.case_ids(df, 5, 2024, "k").orderBy("k").collect()
    assert [r["case_id"] for r in rows] == [f"CASE-2024-{i:06d}" for i in range(5, 105)]
