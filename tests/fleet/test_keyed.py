"""Keyed state: timers from the watermark, sliding windows, suppression with resolutions, retention."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from aerolith.operators import rules
from aerolith.streaming import keyed
from aerolith.streaming.lifecycle import stream_lifecycle

from .test_streams import POSITIONS, T0, end, files, fixes


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def parquet(df, tmp_path, mode="append"):
    return df.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))


def minute(ts):
    return (ts - T0).total_seconds() / 60


def test_silence_is_told_by_the_watermark_alone(spark, tmp_path):
    # b, c and d have no row in the later batches; only a moves the watermark
    batches = [fixes(("a", False, 0), ("b", False, 0), ("c", False, 0), ("c", False, 14)), fixes(("a", False, 16)), fixes(("b", False, 20), ("d", False, 20), ("a", False, 21)), fixes(("a", False, 45)), fixes(("a", False, 50), ("c", False, 50), ("c", False, 10))]
    end(parquet(keyed.stream_silence(files(spark, str(tmp_path / "in"), POSITIONS, batches)), tmp_path))
    got = sorted((r["icao24"], minute(r["told_at"]), r["kind"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 14, "silent"), ("a", 16, "back"), ("a", 35, "silent"), ("a", 45, "back"), ("b", 14, "silent"), ("b", 20, "back"), ("b", 34, "silent"), ("c", 28, "silent"), ("c", 44, "lost"), ("d", 34, "silent")]
    # d's and b's timers for minute 50 wait for a later watermark; nothing is kept of what is lost, but c came again
    left = {r["key"]["icao24"]: r["value"]["told"] for r in keyed.read_state(spark, str(tmp_path / "checkpoint"), "fix").collect()}
    assert left == {"a": 0, "b": 1, "c": 0, "d": 1}


def test_rules_at_every_slide_equal_the_batch_rules(spark, tmp_path):
    import random

    rng = random.Random(8)
    schema = "event_id long, icao24 string, callsign string, customer_region string, on_ground boolean, altitude_ft int, heading_deg int, nearest_site_icao string, nearest_site_distance_nm double, ts_polled timestamp"
    rows = [(i, rng.choice("abcd"), rng.choice(["AVX1", "N1QX", None, "AVX2"]), rng.choice(["west", "east"]), rng.random() < 0.1, rng.choice([None, *range(500, 6_000, 300)]), rng.choice([None, *range(0, 360, 20)]), rng.choice(["KAAA", "KBBB"]), rng.uniform(0, 18), at(rng.randrange(0, 180) / 2)) for i in range(500)]
    rows.sort(key=lambda r: r[-1])
    options = {"excessive_hold": {"min_fixes": 8, "min_minutes": 20, "min_sectors": 5}, "go_around": {"descent_ft": 800, "climb_ft": 800}}
    stream = files(spark, str(tmp_path / "in"), schema, [rows[k : k + 100] for k in range(0, 500, 100)])
    end(parquet(keyed.stream_near_rules(stream, options), tmp_path))
    got = {(r["rule"], r["icao24"], minute(r["told_at"]), r["site_icao"], r["customer_region"], r["callsign"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    positions, want = spark.createDataFrame(rows, schema).cache(), set()
    for slide in range(0, int(minute(rows[-1][-1])), 5):
        window = positions.filter(F.col("ts_polled").between(F.lit(at(slide - 30)), F.lit(at(slide))))
        ctx = rules.Context(window, None, None, None, near=window)
        for rule in (rules.ExcessiveHold(), rules.GoAround()):
            found = rule.detect(ctx, **options[rule.case_type]).withColumn("callsign", F.get_json_object("detection_facts", "$.callsign")).collect()
            want |= {(r["rule"], r["icao24"], float(slide), r["site_icao"], r["customer_region"], r["callsign"]) for r in found}
    assert got == want and len({r[0] for r in want}) == 2 and len(want) > 10
    # one window of each aircraft is all that is left
    newest = max(r["value"]["slide_ms"] for r in keyed.read_state(spark, str(tmp_path / "checkpoint"), "told").collect())
    kept = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "fixes").option("flattenCollectionTypes", "true").load()
    assert kept.select(F.min("list_element.ms")).first()[0] >= newest + 300_000 - 1_800_000


def test_a_resolved_case_frees_its_key_at_once(spark, tmp_path):
    finding = lambda key, name, m: ("f", key, "go_around", name, None, None, None, at(m))
    case = lambda key, name, made, status, m: ("c", key, "go_around", None, name, at(made), status, at(m))
    schema = "kind string, dedup_key string, rule string, finding string, case_id string, created_at timestamp, status string, ts timestamp"
    batches = [
        [finding("k", "f1", 0), finding("k", "f2", 3), case("j", "c9", 0, "open", 0)],
        [case("k", "c1", 0, "open", 4), finding("k", "f3", 10), finding("j", "g1", 10)],
        [case("k", "c1", 0, "resolved", 12), finding("k", "f4", 12), finding("k", "f5", 13)],
        [finding("j", "g2", 30), finding("j", "g3", 31), finding("k", "f6", 50), case("j", "c9", 0, "closed", 55)],
        [finding("x", "x1", 200)],
    ]
    stream = files(spark, str(tmp_path / "in"), schema, batches)
    found = stream.filter("kind = 'f'").withColumn("detected_at", F.col("ts"))
    changes = stream.filter("kind = 'c'").withColumns({"case_type": F.col("rule"), "updated_at": F.col("ts")})
    end(parquet(keyed.stream_suppress(found, changes), tmp_path))
    got = sorted(r["finding"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # f4 has the case resolved in its very minute; f5 meets f4; g3 is past the window of half an hour; f6 past that of f4
    assert got == ["f1", "f4", "f6", "g3", "x1"]


def test_last_known_state_expires_by_the_watermark(spark, tmp_path):
    batches = [fixes(("a", True, 0), ("b", False, 0), ("b", False, -1)), fixes(("a", False, 100), ("b", False, -5)), fixes(("a", False, 181))]
    stream = files(spark, str(tmp_path / "in"), POSITIONS, batches)
    changes = keyed.stream_last_known(stream)
    seen = []
    end(changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(lambda df, n: seen.extend((r["icao24"], minute(r["last_seen_at"]), r["gone"]) for r in df.collect())))
    assert sorted(seen) == [("a", 0, False), ("a", 100, False), ("a", 181, False), ("b", 0, False), ("b", 0, True)]
    assert [r["key"]["icao24"] for r in keyed.read_state(spark, str(tmp_path / "checkpoint"), "last").collect()] == ["a"]


@pytest.fixture
def no_empty_batches(spark):
    """A stream on the clock always has another empty batch to run, so a run to the end would have none."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_last_known_state_expires_by_the_clock(spark, tmp_path, no_empty_batches):
    def run(name, rows):
        spark.createDataFrame(rows, POSITIONS).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(POSITIONS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        changes = keyed.stream_last_known(stream, hours=1 / 1800, clock=True)  # two seconds
        end(changes.writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "checkpoint")))
        return {r["key"]["icao24"] for r in keyed.read_state(spark, str(tmp_path / "checkpoint"), "last").collect()}

    assert run("0", fixes(("a", True, 0), ("b", False, 0))) == {"a", "b"}
    time.sleep(3)
    assert run("1", fixes(("c", True, 1))) == {"c"}


def test_an_absent_aircraft_is_forgotten_by_the_clock(spark, tmp_path, no_empty_batches):
    for name, rows in (("0", fixes(("a", True, 0), ("b", True, 0))), ("1", fixes(("a", False, 1)))):
        spark.createDataFrame(rows, POSITIONS).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(POSITIONS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        end(parquet(stream_lifecycle(stream, ttl_s=2), tmp_path))
        time.sleep(3)
    # a was on the ground before, but that has been forgotten: its fix in the air only seeds
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0
    left = keyed.read_state(spark, str(tmp_path / "checkpoint"), "aircraft").select("key.icao24").collect()
    assert {r["icao24"] for r in left} == {"a"}
