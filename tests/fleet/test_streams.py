"""Streams against the batch operators."""

import datetime as dt
import json

from pyspark.sql import functions as F

from aerolith.operators import rules
from aerolith.sources import lake
from aerolith.streaming import jobs
from aerolith.streaming.tables import VersionedTable

T0 = dt.datetime(2024, 5, 1, 12, 0)


def files(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def end(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


POSITIONS = "icao24 string, callsign string, lat double, lon double, on_ground boolean, ts_polled timestamp, ts_position timestamp"


def fixes(*rows):
    return [(i, "X", 1.0, 2.0, g, T0 + dt.timedelta(minutes=m), None) for i, g, m in rows]


def test_current_state(spark, tmp_path):
    batches = [fixes(("a", True, 0), ("b", False, 0)), fixes(("a", False, 10), ("b", False, -5)), fixes(("a", False, 20))]
    stream = files(spark, str(tmp_path / "in"), POSITIONS, batches)
    state = VersionedTable(spark, str(tmp_path / "state"))
    end(jobs.stream_current(stream, state, str(tmp_path / "checkpoint")))
    seen = {r["icao24"]: r["last_seen_at"] for r in state.read().collect()}
    assert seen == {"a": T0 + dt.timedelta(minutes=20), "b": T0}
    assert [(r["icao24"], r["gap_minutes"]) for r in jobs.gaps(state.read(), F.lit(T0 + dt.timedelta(minutes=20))).collect()] == [("b", 20.0)]
    assert len(state.versions()) == 3


def test_versions_are_idempotent(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), keep=2)
    for n in range(4):
        table.write(spark.range(n + 1), n)
    table.write(spark.range(9), 3)
    assert table.versions() == [2, 3] and table.read().count() == 9 and table.read(before=3).count() == 3


def test_ingest(spark, tmp_path):
    vector = ["abc123", "X", "US", 1714565000, 1714565000, -99.9, 40.1, 1000.0, False, 100.0, 90.0, 0.0, None, None, None, False, 0]
    for i in range(2):
        (tmp_path / f"in{i}.json").write_text(json.dumps({"time": 1714565000 + 300 * i, "states": [vector]}))
    prefixes = spark.createDataFrame([("ff",)], "prefix string")
    sites = spark.createDataFrame([("KAAA", 40.0, -100.0, ["west"])], "icao string, lat double, lon double, customer_regions array<string>")
    stream = jobs.stream_ingest(spark, str(tmp_path / "in*.json"), prefixes, sites)
    end(jobs.write_hours(stream, str(tmp_path / "lake"), str(tmp_path / "checkpoint")))
    rows = lake.scan_positions(spark, str(tmp_path / "lake")).collect()
    assert len(rows) == 2 and {r["customer_region"] for r in rows} == {"west"} and {r["altitude_ft"] for r in rows} == {3281}


def test_dedup_within_the_window(spark, tmp_path):
    schema = "rule string, dedup_key string, detected_at timestamp"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[("go_around", "k1", at(0)), ("go_around", "k1", at(1)), ("delay", "k1", at(0))], [("go_around", "k1", at(20)), ("go_around", "k2", at(21))], [("go_around", "k3", at(200))], [("go_around", "k3", at(300))], [("go_around", "k1", at(400))]]
    stream = files(spark, str(tmp_path / "in"), schema, batches)
    end(jobs.stream_dedup(stream, rules.GoAround()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")))
    got = sorted((r["dedup_key"], r["detected_at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ("k2", at(21)) in got and sum(1 for k, t in got if k == "k1" and t < at(30)) == 1 and ("k1", at(400)) in got


def test_case_mirror(spark, tmp_path):
    schema = "case_id string, case_type string, site_icao string, detection_facts string, status string, updated_at timestamp"
    row = lambda i, s, m: (i, "delay", "KAAA", '{"callsign":"X"}', s, T0 + dt.timedelta(minutes=m))
    stream = files(spark, str(tmp_path / "in"), schema, [[row("c1", "open", 0), row("c2", "open", 0)], [row("c1", "closed", 5), row("c1", "in_progress", 3)]])
    table = VersionedTable(spark, str(tmp_path / "mirror"))
    end(jobs.stream_case_mirror(stream, table, str(tmp_path / "checkpoint")))
    got = {r["case_id"]: (r["status"], r["subject"]) for r in table.read().collect()}
    assert got == {"c1": ("closed", "Delayed flight — X ?→?"), "c2": ("open", "Delayed flight — X ?→?")}


def test_rules_over_a_sliding_window(spark, tmp_path):
    schema = POSITIONS + ", altitude_ft int, heading_deg int, vertical_rate_fpm int, customer_region string"
    def scene(m, *aircraft):
        return [(i, "DAL1", 40.0, -100.0, False, T0 + dt.timedelta(minutes=m), None, 28_000, 90, 0, "west") for i in aircraft]

    stream = files(spark, str(tmp_path / "in"), schema, [scene(0, "a", "b"), scene(16, "b"), scene(60, "b")])
    sites = spark.createDataFrame([("KAAA", 40.0, -100.0)], "icao string, lat double, lon double")
    plans = spark.createDataFrame([], "icao24 string, origin_icao string, destination_icao string, departure_time timestamp, fetch_status string")
    weather = spark.createDataFrame([], "site_icao string, flight_category string, ceiling_ft int, visibility_sm double, wind_kt int")
    cells = spark.createDataFrame([], "lat_cell int, lon_cell int")
    cases = spark.createDataFrame([], "case_type string, flight_id string, site_icao string, detection_facts string, status string, created_at timestamp")
    history, out = VersionedTable(spark, str(tmp_path / "history"), keep=9), VersionedTable(spark, str(tmp_path / "out"), keep=9)
    context = lambda p: rules.Context(rules.enrich(p, plans, sites), weather, cells, sites)
    end(jobs.stream_rules(stream, history, out, context, lambda: cases, str(tmp_path / "checkpoint")))
    found = [[(r["rule"], r["icao24"]) for r in spark.read.parquet(out._path(v)).collect()] for v in out.versions()]
    assert found == [[], [("lost_signal", "a")], []]
    assert history.read().count() == 1
