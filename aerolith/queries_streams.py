"""Queries that run a stream to its end over rows that Spark has written as files."""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .functions import scalars as sc
from .operators import joins, rules
from .queries_positions import _EDGE, _ENRICH, _GA, NEAREST, state_vector
from .registry import CURRENT, Tables, long, query, sec
from .sources import lake
from .streaming import jobs, keyed, pull
from .streaming.lifecycle import stream_lifecycle
from .streaming.tables import VersionedTable


def scratch(t: Tables) -> str:
    return shared.scratch(t.spark)


def _stream(t: Tables, df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(f"{folder}/in")
    return t.spark.readStream.schema(df.schema).parquet(f"{folder}/in")


def _run(t: Tables, writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@contextmanager
def rocksdb(t: Tables):
    """Keyed state needs this store; it is the session's setting when a stream starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key, None)
    t.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        t.spark.conf.unset(key) if before is None else t.spark.conf.set(key, before)


def _append(t: Tables, df: DataFrame, folder: str) -> DataFrame:
    """Run an appending stream to its end; all that it has written so far."""
    with rocksdb(t):
        _run(t, df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint"))
    return t.spark.read.schema(df.schema).parquet(f"{folder}/out")


@query("t2_stream_current", f"{CURRENT} SELECT icao24, {sec('last_seen_at')} AS last_seen_at FROM current", "positions")
def _(t):
    folder = scratch(t)
    table = VersionedTable(t.spark, f"{folder}/table")
    _run(t, jobs.stream_current(_stream(t, t.positions.drop("event_id"), folder), table, f"{folder}/checkpoint"))
    return table.read().select("icao24", "last_seen_at")


@query("t8_stream_pull", f"SELECT salesforce_id, external_id, crm_status, priority, summary, {sec('resolved_at')} AS resolved_at, record_type, {sec('modstamp')} AS modstamp FROM crm WHERE record_type = 'fleet' AND modstamp > TIMESTAMP '1994-12-31 23:00:00'", "crm")
def _(t):
    folder, late = scratch(t), F.col("modstamp") >= F.lit("1997-01-01 00:00:00").cast("timestamp")
    for part in (t.crm.filter(~late), t.crm.filter(late), t.crm.limit(0)):  # the second pull resumes, the third finds nothing
        part.write.mode("append").parquet(f"{folder}/in")
        _append(t, pull.stream_changes(t.spark, f"{folder}/in", dt.datetime(1995, 1, 1, tzinfo=dt.timezone.utc)), folder)
    return t.spark.read.parquet(f"{folder}/out")


@query("t3_stream_lifecycle", f"{_EDGE} SELECT * FROM edges WHERE flight_id IS NOT NULL", "positions")
def _(t):
    folder = scratch(t)
    return _append(t, stream_lifecycle(_stream(t, t.positions, folder), tie="event_id"), folder)


@query(
    "t5_hold_windows",
    f"""w AS (SELECT *, {sec('ts_polled')} - {sec('ts_polled')} % 300 - 300 * k AS window_start FROM positions CROSS JOIN (SELECT unnest(range(0, 6)) AS k))
SELECT window_start, icao24, count(*) AS n, round(({sec('max(ts_polled)')} - {sec('min(ts_polled)')}) / 60.0, 6) AS minutes, count(DISTINCT floor(heading_deg % 360 / 45)) AS sectors FROM w GROUP BY window_start, icao24""",
    "positions",
)
def _(t):
    return jobs.hold_windows(t.positions)


@query("t1_stream_ingest", f"{NEAREST} SELECT p.event_id % 1000000000 AS last_contact_s, p.icao24, {sec('ts_polled')} AS ts_polled, {long('round_even(altitude_ft * CAST(0.3 AS DOUBLE) * 3.28084, 0)')} AS altitude_ft, r.customer_region FROM positions p JOIN regions r USING (event_id) WHERE icao24 NOT LIKE 'a0000%'", "positions", "airports")
def _(t):
    folder = scratch(t)
    # the event's number travels as squawk, a text that is passed through
    vector = state_vector(F.col("event_id").cast("string"), (F.col("altitude_ft") * F.lit(0.3)).cast("string"))
    states = t.positions.groupBy("ts_polled").agg(F.collect_list(vector).alias("states"))
    # a poll is a line: there are tens of thousands
    states.select(F.to_json(F.struct(sc.epoch("ts_polled").alias("time"), "states")).alias("value")).write.text(f"{folder}/in")
    prefixes = t.spark.createDataFrame([("a0000",)], "prefix string")
    rows = jobs.stream_ingest(t.spark, f"{folder}/in", prefixes, t.airports.filter("is_watched"), lines=True)
    _run(t, jobs.write_hours(rows, f"{folder}/lake", f"{folder}/checkpoint"))
    return lake.scan_positions(t.spark, f"{folder}/lake").select(F.col("squawk").cast("long").alias("last_contact_s"), "icao24", "ts_polled", "altitude_ft", "customer_region")


_SILENCE = f"""n AS (SELECT icao24, {sec('ts_polled')} AS s, {sec('lead(ts_polled) OVER (PARTITION BY icao24 ORDER BY ts_polled)')} AS nxt FROM (SELECT DISTINCT icao24, ts_polled FROM positions)),
w AS (SELECT {sec('max(ts_polled)')} AS w FROM positions)
SELECT icao24, 'silent' AS kind, s + 840 AS told_at FROM n, w WHERE coalesce(nxt, w) > s + 840
UNION ALL SELECT icao24, 'lost', s + 1800 FROM n, w WHERE coalesce(nxt, w) > s + 1800
UNION ALL SELECT icao24, 'back', nxt FROM n WHERE nxt > s + 840 AND nxt <= s + 1800"""


@query("t4_stream_gaps", _SILENCE, "positions")
def _(t):
    folder, early = scratch(t), F.col("ts_polled") < F.lit("2024-01-01 05:30:00").cast("timestamp")
    _append(t, keyed.stream_silence(_stream(t, t.positions.filter(early), folder)), folder)
    t.positions.filter(~early).write.mode("append").parquet(f"{folder}/in")  # what was silent by then has been told by timers
    return _append(t, keyed.stream_silence(t.spark.readStream.schema(t.positions.schema).parquet(f"{folder}/in")), folder)


_SLIDES = f"""{_ENRICH},
slid AS (SELECT *, s - s % 300 + (CASE WHEN s % 300 > 0 THEN 300 ELSE 0 END) + 300 * k AS slide FROM (SELECT *, {sec('ts_polled')} AS s, unnest(range(0, 7)) AS k FROM enriched WHERE nm <= 15 AND NOT on_ground)),
open_rows AS (SELECT * FROM slid WHERE s >= slide - 1800 AND slide < (SELECT max(s) FROM slid)),
near_h AS (SELECT * FROM open_rows WHERE altitude_ft <= 15000),
near_a AS (SELECT *, first_value(altitude_ft) OVER w AS low, first_value(s) OVER w AS low_s FROM open_rows WHERE nm <= 10 WINDOW w AS (PARTITION BY icao24, slide ORDER BY altitude_ft, s)),
site_h AS (SELECT icao24, slide, site, row_number() OVER (PARTITION BY icao24, slide ORDER BY count(*) DESC, site) AS r FROM near_h GROUP BY icao24, slide, site),
site_a AS (SELECT icao24, slide, site, row_number() OVER (PARTITION BY icao24, slide ORDER BY count(*) DESC, site) AS r FROM near_a GROUP BY icao24, slide, site),
h AS (SELECT icao24, slide, count(*) AS n, max(s) - min(s) AS span, count(DISTINCT floor(heading_deg % 360 / 45)) AS sectors, arg_max(struct_pack(cs := callsign, region := customer_region), struct_pack(a := s, b := event_id)) AS last FROM near_h GROUP BY icao24, slide),
a AS (SELECT icao24, slide, count(*) AS n, min(low) AS low, max(CASE WHEN s < low_s THEN altitude_ft END) - min(low) AS descent, max(CASE WHEN s > low_s THEN altitude_ft END) - min(low) AS climb, arg_max(struct_pack(cs := callsign, region := customer_region), struct_pack(a := s, b := event_id)) AS last FROM near_a GROUP BY icao24, slide)
SELECT 'excessive_hold' AS rule, icao24, slide AS told_at, site AS site_icao, last.region AS customer_region, last.cs AS callsign, n, round(span / 60.0, 6) AS minutes, sectors, NULL::BIGINT AS min_altitude_ft, NULL::BIGINT AS descent_ft, NULL::BIGINT AS climb_ft
FROM h JOIN site_h USING (icao24, slide) WHERE r = 1 AND n >= 3 AND span >= 600 AND sectors >= 3 AND NOT {_GA.format('last.cs')}
UNION ALL SELECT 'go_around', icao24, slide, site, last.region, last.cs, n, NULL, NULL, low, descent, climb
FROM a JOIN site_a USING (icao24, slide) WHERE r = 1 AND n >= 3 AND low <= 6000 AND descent >= 500 AND climb >= 500 AND NOT {_GA.format('last.cs')}"""


@query("t5_stream_rules", _SLIDES, "positions", "plans", "airports")
def _(t):
    folder, sites = scratch(t), t.airports.filter("is_watched")
    near = joins.nearest_site(t.positions.filter("customer_region is not null"), sites)
    options = {"excessive_hold": {"min_fixes": 3, "min_minutes": 10, "min_sectors": 3}, "go_around": {"floor_ft": 6_000, "descent_ft": 500, "climb_ft": 500}}
    near = near.filter((F.col("nearest_site_distance_nm") <= 15) & ~F.col("on_ground"))
    return _append(t, keyed.stream_near_rules(_stream(t, near, folder), options), folder)


@query("t6_stream_suppression", "SELECT DISTINCT concat('go_around|', flight_id, '|', site_icao) AS dedup_key FROM cases WHERE case_type = 'go_around'", "cases")
def _(t):
    folder = scratch(t)
    rule = next(r for r in rules.REGISTRY if r.case_type == "go_around")
    found = t.cases.select(F.col("case_type").alias("rule"), rule.dedup_key("site_icao", "flight_id", "detection_facts").alias("dedup_key"), F.col("created_at").alias("detected_at"))
    once = jobs.stream_dedup(_stream(t, found, folder), rule).select("dedup_key")
    _run(t, once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint"))
    return t.spark.read.schema("dedup_key string").parquet(f"{folder}/out")


@query("t7_stream_case_mirror", f"SELECT case_id, status, {sec('updated_at')} + 60 AS updated_at FROM cases WHERE case_type = 'delay' UNION ALL SELECT case_id, status, {sec('updated_at')} FROM cases WHERE case_type <> 'delay'", "cases")
def _(t):
    folder = scratch(t)
    table, checkpoint = VersionedTable(t.spark, f"{folder}/table"), f"{folder}/checkpoint"
    _run(t, jobs.stream_case_mirror(_stream(t, t.cases, folder), table, checkpoint))
    newer = t.cases.filter("case_type = 'delay'").withColumn("updated_at", F.col("updated_at") + F.expr("interval 60 seconds"))
    newer.write.mode("append").parquet(f"{folder}/in")  # a second batch, of which only touched buckets are written
    _run(t, jobs.stream_case_mirror(t.spark.readStream.schema(t.cases.schema).parquet(f"{folder}/in"), table, checkpoint))
    return table.read().select("case_id", "status", "updated_at")


@query("t10_late_rows", f"{CURRENT} SELECT icao24, {sec('last_seen_at')} AS last_seen_at FROM current", "positions")
def _(t):
    folder = scratch(t)
    table, checkpoint = VersionedTable(t.spark, f"{folder}/table"), f"{folder}/checkpoint"
    rows, early = t.positions.drop("event_id"), F.col("event_id") % 2 == 0
    _run(t, jobs.stream_current(_stream(t, t.positions.filter(~early).drop("event_id"), folder), table, checkpoint))
    t.positions.filter(early).drop("event_id").write.mode("append").parquet(f"{folder}/in")  # many of these are older than what is known
    _run(t, jobs.stream_current(t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), table, checkpoint))
    return table.read().select("icao24", "last_seen_at")


@query("t11_expired_state", f"{CURRENT} SELECT icao24, {sec('last_seen_at')} AS last_seen_at FROM current WHERE last_seen_at >= (SELECT max(ts_polled) FROM positions) - INTERVAL 3 HOUR", "positions")
def _(t):
    folder = scratch(t)
    changes = keyed.stream_last_known(_stream(t, t.positions, folder))
    with rocksdb(t):
        _run(t, changes.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{folder}/checkpoint"))
    state = keyed.read_state(t.spark, f"{folder}/checkpoint", "last")
    return state.select(F.col("key.icao24").alias("icao24"), F.timestamp_millis("value.seen_ms").alias("last_seen_at"))


_KEYED = "k AS (SELECT *, concat('go_around|', flight_id, '|', coalesce(site_icao, '')) AS dedup_key, {0} AS made, {1} AS changed FROM cases WHERE case_type = 'go_around')".format(sec("created_at"), sec("updated_at"))


@query(
    "t6_open_cases",
    f"""{_KEYED}, f AS (SELECT case_id AS finding, dedup_key, made + 600 AS told_at FROM k UNION ALL SELECT case_id || '-late', dedup_key, made + 2400 FROM k)
SELECT finding, dedup_key, told_at FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.dedup_key = f.dedup_key AND made <= told_at AND told_at - made <= 1800 AND NOT (status IN ('resolved', 'closed') AND made + 300 <= told_at))""",
    "cases",
)
def _(t):
    folder = scratch(t)
    rule = next(r for r in rules.REGISTRY if r.case_type == "go_around")
    cases = t.cases.filter("case_type = 'go_around'").withColumn("dedup_key", rule.dedup_key("site_icao", "flight_id", "detection_facts"))
    # a case as it came, and five minutes later as it stands; what is found ten and forty minutes after it came
    later = lambda m: F.col("created_at") + F.expr(f"interval {m} minutes")
    columns = ["dedup_key", "case_id", "case_type", "created_at", "status", "updated_at"]
    changes = cases.withColumns({"status": F.lit("open"), "updated_at": F.col("created_at")}).select(*columns).unionByName(cases.withColumn("updated_at", later(5)).select(*columns))
    found = cases.select("dedup_key", F.col("case_type").alias("rule"), F.col("case_id").alias("finding"), later(10).alias("detected_at"))
    found = found.unionByName(cases.select("dedup_key", F.col("case_type").alias("rule"), F.concat("case_id", F.lit("-late")).alias("finding"), later(40).alias("detected_at")))
    out = keyed.stream_suppress(_stream(t, found, f"{folder}/found"), _stream(t, changes, f"{folder}/changes"), own=False)
    return _append(t, out, folder).select("finding", "dedup_key", "told_at")


@query(
    "t9_stream_kpis",
    f"""w AS (SELECT handler, {sec('ts')} - {sec('ts')} % 300 AS window_start, status, duration_seconds FROM request_log),
k AS (SELECT *, row_number() OVER (PARTITION BY handler, window_start ORDER BY duration_seconds) AS k, count(*) OVER (PARTITION BY handler, window_start) AS n FROM w)
SELECT window_start, handler, CAST(count(*) AS BIGINT) AS n, round(count(*) / 300.0, 6) AS rate, round(count(*) FILTER (WHERE status <> 200) / count(*), 6) AS error_rate, round(min(duration_seconds) FILTER (WHERE k >= 0.95 * n), 6) AS p95_s
FROM k WHERE window_start + 300 <= (SELECT max({sec('ts')}) - 600 FROM request_log) GROUP BY handler, window_start""",
    "request_log",
)
def _(t):
    folder = scratch(t)
    kpis = jobs.stream_kpis(_stream(t, t.request_log, folder))
    _run(t, kpis.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint"))
    return t.spark.read.schema(kpis.schema).parquet(f"{folder}/out")


@query("s10_recent_positions", f"SELECT icao24, {sec('ts_polled')} AS ts_polled FROM positions WHERE ts_polled >= (SELECT max(ts_polled) FROM positions) - INTERVAL 90 MINUTE", "positions")
def _(t):
    folder = scratch(t)
    rows = t.positions.drop("event_id").withColumns(lake.parts("ts_polled", lake.HOUR))
    rows.write.partitionBy(*lake.HOUR).option("compression", "zstd").parquet(f"{folder}/lake")
    newest = t.positions.agg(F.max("ts_polled")).first()[0]
    return lake.recent_positions(t.spark, f"{folder}/lake", 90, newest).select("icao24", "ts_polled")
