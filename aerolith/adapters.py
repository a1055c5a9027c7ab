"""Fleet tables derived from the given tables, in one SQL text for Spark and DuckDB.

The given tables hold no aircraft; each view below maps one of them to a fleet table
with integer arithmetic only, so that both engines compute the same rows.  A few
marks in the text stand for what the dialects spell differently:

``@epoch(x)``  seconds since 1970 of a timestamp;  ``@list(a, b)``  an array;
``@hex(x)``  hex digits of an integer;  ``@ts(x)``  timestamp of epoch seconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

START = 1704067200  # 2024-01-01

AIRCRAFT = "lower(@hex({0} + 10485760))"
SITE = "concat('K', lpad(CAST({0} AS STRING), 3, '0'))"

VIEWS: dict[str, tuple[str, str]] = {
    # positions: 30 days of events squeezed into 12 hours; a third of the aircraft cruise, a third fly low near a site
    "positions": (
        "events",
        f"""
SELECT event_id, {AIRCRAFT.format('user_id')} AS icao24,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN user_id % 5 = 0 THEN concat('N', CAST(user_id AS STRING), 'QX') ELSE concat('AVX', CAST(user_id AS STRING)) END AS callsign,
  CAST('United States' AS STRING) AS origin_country,
  CAST(3000 + user_id % 25 * 80 + (event_id * 7 % 41 - 20) + (CASE WHEN user_id % 3 = 0 THEN 150 ELSE 0 END) AS DOUBLE) / 100 AS lat,
  CAST(-12000 + user_id % 25 * 200 + (event_id * 11 % 41 - 20) AS DOUBLE) / 100 AS lon,
  CAST(CASE WHEN event_id % 10 = 0 THEN 0 WHEN user_id % 3 = 0 THEN 24000 + (event_id * 37 % 160) * 100 ELSE (event_id * 31 % 140) * 100 END AS INT) AS altitude_ft,
  CAST(100 + event_id * 19 % 400 AS INT) AS speed_kt, CAST(event_id * 53 % 360 AS INT) AS heading_deg,
  CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id * 11 % 1600 - 800 END AS INT) AS vertical_rate_fpm,
  event_id % 10 = 0 AS on_ground, CAST(NULL AS STRING) AS squawk,
  @ts({START} + CAST(floor((@epoch(ts) - {START}) / 60) AS BIGINT)) AS ts_polled,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE @ts({START} + CAST(floor((@epoch(ts) - {START}) / 60) AS BIGINT) - event_id % 9) END AS ts_position,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 2 THEN 'east' WHEN user_id % 5 = 3 THEN 'all' ELSE 'west' END AS customer_region
FROM events""",
    ),
    "airports": (
        "nation",
        f"""
SELECT {SITE.format('n_nationkey')} AS icao, concat('I', CAST(n_nationkey AS STRING)) AS iata, n_name AS name, n_name AS city,
  concat('US-', substr(n_name, 1, 2)) AS iso_region, CAST(300 + n_nationkey * 8 AS DOUBLE) / 10 AS lat, CAST(-120 + n_nationkey * 2 AS DOUBLE) AS lon,
  CAST(n_nationkey * 100 AS INT) AS elevation_ft, n_nationkey % 6 <> 5 AS is_watched,
  CASE n_regionkey WHEN 0 THEN CAST(@list() AS @strings) WHEN 1 THEN @list('west') WHEN 2 THEN @list('east') WHEN 3 THEN @list('west', 'east') ELSE @list('west') END AS customer_regions
FROM nation""",
    ),
    "registry": (
        "customer",
        f"""
SELECT {AIRCRAFT.format('c_custkey')} AS icao24, concat('N', CAST(c_custkey AS STRING)) AS registration,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS aircraft_type, concat('OP', CAST(c_nationkey AS STRING)) AS operator_icao
FROM customer""",
    ),
    "plans": (
        "customer",
        f"""
SELECT {AIRCRAFT.format('c_custkey')} AS icao24, {SITE.format('c_custkey % 25')} AS origin_icao, {SITE.format('(c_custkey * 7 + 3) % 25')} AS destination_icao,
  @ts({START} + c_custkey % 700 * 60) AS departure_time, @ts({START} - c_custkey % 30 * 3600) AS refreshed_at,
  CASE c_custkey % 8 WHEN 0 THEN 'not_found' WHEN 1 THEN 'error' ELSE 'success' END AS fetch_status
FROM customer""",
    ),
    "conditions": (
        "supplier",
        f"""
SELECT {SITE.format('s_suppkey - 1')} AS site_icao, CAST(CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(floor(abs(s_acctbal)) AS BIGINT) % 4000 END AS INT) AS ceiling_ft,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 80 AS DOUBLE) / 10 END AS visibility_sm,
  CAST(s_suppkey % 40 AS INT) AS wind_kt, CAST(NULL AS STRING) AS metar_raw, @ts({START} + s_suppkey % 600) AS metar_observed_at
FROM supplier""",
    ),
    "cases": (
        "orders",
        f"""
SELECT concat('CASE-2024-', lpad(CAST(o_orderkey AS STRING), 7, '0')) AS case_id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('500', CAST(o_orderkey AS STRING)) END AS salesforce_id,
  {AIRCRAFT.format('o_custkey')} AS flight_id, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE {SITE.format('o_custkey % 25')} END AS site_icao,
  CASE o_custkey % 4 WHEN 0 THEN 'west' WHEN 1 THEN 'east' ELSE 'all' END AS customer_region,
  CASE o_orderkey % 6 WHEN 0 THEN 'lost_signal' WHEN 1 THEN 'diversion' WHEN 2 THEN 'excessive_hold' WHEN 3 THEN 'weather_impact' WHEN 4 THEN 'go_around' ELSE 'delay' END AS case_type,
  CASE WHEN o_orderkey % 11 = 0 THEN 'closed' WHEN o_orderkey % 13 = 0 THEN 'acknowledged' WHEN o_orderkey % 23 = 0 THEN 'escalated' WHEN o_orderstatus = 'F' THEN 'resolved' WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'open' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '5' THEN 'low' ELSE NULL END AS severity,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('summary ', CAST(o_orderkey AS STRING)) END AS summary,
  CASE WHEN o_orderkey % 5 = 0 THEN 'because of the signal' WHEN o_orderkey % 5 = 1 THEN 'short' ELSE NULL END AS severity_justification,
  concat('{{"callsign":"AVX', CAST(o_custkey AS STRING), '","gap_minutes":', CAST(o_orderkey % 45 AS STRING), ',"last_altitude_ft":', CAST(20000 + o_orderkey % 150 * 100 AS STRING),
    ',"last_lat":', CAST(30 + o_custkey % 20 AS STRING), '.5,"last_lon":-', CAST(100 + o_custkey % 20 AS STRING), '.5,"flight_category":"IFR","origin":"', {SITE.format('o_custkey % 25')}, '","destination":"', {SITE.format('o_orderkey % 25')}, '","expected_destination":null,"path":[1,2]}}') AS detection_facts,
  CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'synced' WHEN 2 THEN 'failed' ELSE 'skipped' END AS sf_sync_status, CAST(o_orderkey % 5 AS INT) AS sf_sync_attempts,
  @ts(@epoch(o_orderdate) + o_orderkey % 1440 * 60) AS created_at, @ts(@epoch(o_orderdate) + o_orderkey % 1440 * 60 + o_orderkey % 97 * 3600) AS updated_at,
  CASE WHEN o_orderkey % 11 = 0 OR (o_orderstatus = 'F' AND o_orderkey % 13 <> 0 AND o_orderkey % 23 <> 0) THEN @ts(@epoch(o_orderdate) + o_orderkey % 1440 * 60 + o_custkey % 240 * 1800) ELSE NULL END AS resolved_at
FROM orders""",
    ),
    "timeline": (
        "lineitem",
        """
SELECT l_orderkey * 10 + l_linenumber AS event_id, concat('CASE-2024-', lpad(CAST(l_orderkey AS STRING), 7, '0')) AS case_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'status_changed' WHEN 1 THEN 'created' ELSE 'sf_synced' END AS event_type, @ts(@epoch(l_shipdate)) AS occurred_at
FROM lineitem""",
    ),
    # stored flights: some completed, some live, a few with malformed keys
    "flights": (
        "orders",
        f"""
SELECT CASE WHEN o_orderkey % 97 = 0 THEN concat('bad', CAST(o_orderkey AS STRING)) ELSE concat({AIRCRAFT.format('o_custkey')}, '-', CAST({START} - 172800 + o_orderkey * 37 % 3600 * 60 AS STRING)) END AS flight_id,
  {AIRCRAFT.format('o_custkey')} AS icao24, @ts({START} - 172800 + o_orderkey * 37 % 3600 * 60) AS takeoff_ts,
  CASE WHEN o_orderkey % 3 = 0 THEN @ts({START} - 172800 + o_orderkey * 37 % 3600 * 60 + 5400) ELSE NULL END AS landed_at, o_orderkey % 5 = 0 AS is_live
FROM orders""",
    ),
    "request_log": ("events", "SELECT event_id, event_type AS handler, CASE WHEN event_id % 20 = 0 THEN 500 ELSE 200 END AS status, value AS duration_seconds, @ts(@epoch(ts)) AS ts, props FROM events"),
    "run_log": (
        "orders",
        """
SELECT o_orderkey AS run_id, o_orderpriority AS pipeline_name, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'STARTED' ELSE 'FAILURE' END AS status,
  @ts(@epoch(o_orderdate)) AS created_at, @epoch(o_orderdate) AS start_s, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE @epoch(o_orderdate) + o_orderkey % 900 + 1 END AS end_s
FROM orders""",
    ),
    "crm": (
        "orders",
        """
SELECT CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE concat('500', CAST(o_orderkey AS STRING)) END AS salesforce_id,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('CASE-2024-', lpad(CAST(o_orderkey AS STRING), 7, '0')) ELSE NULL END AS external_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'Closed' WHEN 1 THEN 'Working' WHEN 2 THEN 'Escalated' WHEN 3 THEN 'New' ELSE 'Odd' END AS crm_status,
  CASE o_orderkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE NULL END AS priority,
  CASE WHEN o_orderkey % 4 = 1 THEN 'from the crm' ELSE NULL END AS summary, CASE WHEN o_orderkey % 5 = 0 THEN @ts(@epoch(o_orderdate) + 864000) ELSE NULL END AS resolved_at,
  CASE WHEN o_orderkey % 21 = 0 THEN 'other' ELSE 'fleet' END AS record_type, @ts(@epoch(o_orderdate) + o_orderkey % 86400) AS modstamp
FROM orders WHERE o_orderkey % 7 = 0""",
    ),
    "runbooks": (
        "region",
        """
SELECT concat('RB-', CAST(r_regionkey AS STRING)) AS runbook_id, concat('Runbook ', r_name) AS title,
  CASE r_regionkey WHEN 0 THEN @list('lost_signal', 'go_around') WHEN 1 THEN @list('diversion') WHEN 2 THEN @list('delay', 'lost_signal') WHEN 3 THEN @list('weather_impact') ELSE @list('excessive_hold', 'delay') END AS case_types,
  concat('[Auto] collect', chr(10), ' call the tower ', chr(10), chr(10), 'check ', r_name) AS triage_steps
FROM region""",
    ),
}


def _render(sql: str, spark: bool) -> str:
    def epoch(m: re.Match) -> str:
        return f"unix_seconds(CAST({m[1]} AS TIMESTAMP))" if spark else f"CAST(floor(epoch({m[1]})) AS BIGINT)"

    sql = re.sub(r"@epoch\((\w+)\)", epoch, sql)
    sql = sql.replace("@hex(", "hex(" if spark else "to_hex(").replace("@strings", "ARRAY<STRING>" if spark else "VARCHAR[]")
    sql = re.sub(r"@list\(([^)]*)\)", r"array(\1)" if spark else r"[\1]", sql)
    out, at = [], 0  # @ts holds nested brackets
    while (i := sql.find("@ts(", at)) >= 0:
        depth, j = 1, i + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = sql[i + 4 : j - 1]
        out += [sql[at:i], f"timestamp_seconds({inner})" if spark else f"make_timestamp(CAST(({inner}) * 1000000 AS BIGINT))"]
        at = j
    return "".join([*out, sql[at:]])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fleet table ``name`` over the tables in ``sf_dir``; timestamps are in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source, sql = VIEWS[name]
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(re.sub(rf"FROM {source}\b", "FROM {source}", _render(sql, True).replace("{", "{{").replace("}", "}}")), source=table)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` over the named fleet tables."""
    return "WITH " + ",\n".join(f"{n} AS ({_render(VIEWS[n][1], False)})" for n in names) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body
