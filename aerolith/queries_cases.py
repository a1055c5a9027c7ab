"""Queries over cases, flights, CRM changes and logs: reports, stores, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as sc
from .operators import joins, kpi, serving, stores
from .registry import CASE_NOW, OPEN, Tables, long, query, sec
from .sources import exports, upserts

START = "2024-01-01 00:00:00"


def now(t: Tables):
    return t.latest("cases", "created_at")


# -- reports ------------------------------------------------------------------------


@query("a4_sparse_cells", f"f AS (SELECT floor(CAST(json_extract_string(detection_facts, '$.last_lat') AS DOUBLE)) AS la, floor(CAST(json_extract_string(detection_facts, '$.last_lon') AS DOUBLE)) AS lo, json_extract_string(detection_facts, '$.callsign') AS cs FROM cases WHERE case_type = 'lost_signal') SELECT {long('la')} AS lat_cell, {long('lo')} AS lon_cell, count(*) AS fires, count(DISTINCT cs) AS callsigns FROM f GROUP BY la, lo HAVING count(*) >= 8 AND count(DISTINCT cs) >= 6", "cases")
def _(t):
    return kpi.build_sparse_cells(t.cases)


@query(
    "a6_a9_case_counts",
    """c AS (SELECT *, coalesce(severity, 'unknown') AS sev FROM cases)
SELECT sev AS severity, status, NULL AS customer_region, NULL AS case_type, 'severity_status' AS grouping, count(*) AS n FROM c GROUP BY sev, status
UNION ALL SELECT NULL, NULL, customer_region, NULL, 'region', count(*) FROM c GROUP BY customer_region
UNION ALL SELECT NULL, NULL, NULL, case_type, 'type', count(*) FROM c GROUP BY case_type
UNION ALL SELECT sev, NULL, NULL, case_type, 'type_severity', count(*) FROM c GROUP BY sev, case_type""",
    "cases",
)
def _(t):
    return kpi.cases_cube(t.cases)


@query("a10_created_24h", f"SELECT case_type, count(*) AS n FROM cases WHERE created_at >= {CASE_NOW} - INTERVAL 24 HOUR GROUP BY case_type", "cases")
def _(t):
    return kpi.cases_created_24h(t.cases, now(t))


@query("a11_site_topn", "s AS (SELECT site_icao, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, site_icao) AS r FROM cases GROUP BY site_icao) SELECT CASE WHEN r <= 10 THEN site_icao ELSE 'other' END AS site, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1", "cases")
def _(t):
    return kpi.cases_by_site_topn(t.cases, 10)


@query("a12_sync_backlog", "SELECT sf_sync_status, count(*) AS n FROM cases GROUP BY sf_sync_status", "cases")
def _(t):
    return kpi.sync_backlog(t.cases)


@query("a13_runs_24h", "SELECT pipeline_name, status, count(*) AS n FROM run_log WHERE created_at >= (SELECT max(created_at) FROM run_log) - INTERVAL 24 HOUR GROUP BY pipeline_name, status", "run_log")
def _(t):
    return kpi.runs_24h(t.run_log, t.latest("run_log", "created_at"))


@query("a14_last_run", f"r AS (SELECT *, row_number() OVER (PARTITION BY pipeline_name ORDER BY end_s DESC, run_id DESC) AS k FROM run_log WHERE status = 'SUCCESS' AND end_s IS NOT NULL) SELECT pipeline_name, end_s - start_s AS duration_s, {sec('(SELECT max(created_at) FROM run_log)')} - end_s AS age_s FROM r WHERE k = 1", "run_log")
def _(t):
    return kpi.last_run(t.run_log, t.latest("run_log", "created_at"))


@query("a15_push_health", "w AS (SELECT count(*) FILTER (WHERE sf_sync_status = 'failed') AS failed, count(*) FILTER (WHERE sf_sync_status = 'synced') AS synced FROM cases WHERE updated_at >= (SELECT max(updated_at) FROM cases) - INTERVAL 1440 MINUTE) SELECT failed, synced, round(CASE WHEN failed + synced > 0 THEN failed / (failed + synced) ELSE 0 END, 6) AS rate, failed + synced >= 20 AND failed / (failed + synced) >= 0.5 AS unhealthy FROM w", "cases")
def _(t):
    return kpi.push_health(t.cases, t.latest("cases", "updated_at"), 1440)


@query("a20_open_by_rule", f"SELECT case_type, count(*) AS n FROM cases WHERE {OPEN} GROUP BY case_type", "cases")
def _(t):
    return kpi.report_open_by_rule(t.cases)


@query("a21_severity_mix", f"SELECT coalesce(severity, 'unknown') AS severity, count(*) AS n FROM cases WHERE {OPEN} GROUP BY 1", "cases")
def _(t):
    return kpi.report_severity_mix(t.cases)


_MONTH = f"created_at >= {CASE_NOW} - INTERVAL 720 HOUR"


@query("a22_cases_per_site", f"SELECT site_icao, count(*) AS n FROM cases WHERE {_MONTH} GROUP BY site_icao", "cases")
def _(t):
    return kpi.report_per_site(t.cases, now(t))


@query("a23_cases_per_aircraft", f"SELECT flight_id, count(*) AS n FROM cases WHERE {_MONTH} GROUP BY flight_id", "cases")
def _(t):
    return kpi.report_per_aircraft(t.cases, now(t))


@query("a24_mttr", f"SELECT case_type, round(avg(({sec('resolved_at')} - {sec('created_at')}) / 3600.0), 6) AS mean_hours FROM cases WHERE resolved_at >= {CASE_NOW} - INTERVAL 1000 DAY AND resolved_at <= {CASE_NOW} GROUP BY case_type", "cases")
def _(t):
    return kpi.report_mttr(t.cases, now(t), 1000)


@query("a25_created_daily", f"SELECT {sec("date_trunc('day', created_at)")} AS day, count(*) AS n FROM cases WHERE {_MONTH} GROUP BY 1", "cases")
def _(t):
    return kpi.report_created_daily(t.cases, now(t))


@query(
    "a26_kpi_rollups",
    f"""o AS (SELECT * FROM cases WHERE {OPEN})
SELECT 'open_total' AS kpi, 'all' AS label, count(*) AS n FROM o
UNION ALL SELECT 'open_by_severity', coalesce(severity, 'unknown'), count(*) FROM o GROUP BY 2
UNION ALL (SELECT 'top_sites', site_icao, count(*) FROM o GROUP BY site_icao ORDER BY 3 DESC, 2 LIMIT 15)""",
    "cases",
)
def _(t):
    return kpi.kpi_rollups(t.cases)


@query("a27_request_kpis", f"w AS (SELECT handler, {sec('ts')} - {sec('ts')} % 300 AS window_start, status FROM request_log) SELECT window_start, handler, count(*) AS n, round(count(*) / 300.0, 6) AS rate, round(count(*) FILTER (WHERE status <> 200) / count(*), 6) AS error_rate FROM w GROUP BY 1, 2", "request_log")
def _(t):
    return kpi.request_kpis(t.request_log).drop("p95_s")


@query("a29_latency_p95", f"w AS (SELECT handler, {sec('ts')} - {sec('ts')} % 86400 AS window_start, duration_seconds, row_number() OVER v AS k, count(*) OVER (PARTITION BY handler, {sec('ts')} - {sec('ts')} % 86400) AS n FROM request_log WINDOW v AS (PARTITION BY handler, {sec('ts')} - {sec('ts')} % 86400 ORDER BY duration_seconds)) SELECT window_start, handler, round(duration_seconds, 6) AS p95_s FROM w WHERE k = ceil(n * 0.95)", "request_log")
def _(t):
    return kpi.request_kpis(t.request_log, "1 day").select("window_start", "handler", "p95_s")


_HOURS = f"w AS (SELECT handler, {sec('ts')} - {sec('ts')} % 3600 AS window_start, status FROM request_log)"


@query("a29_merged_sketches", f"{_HOURS} SELECT window_start, handler, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (WHERE status <> 200) / count(*), 6) AS error_rate, true AS within FROM w GROUP BY 1, 2", "request_log")
def _(t):
    merged = kpi.merged_kpis(kpi.window_sketches(t.request_log))
    # the rank of each p95 among the hour's own latencies, within twice the sketch's error
    log = t.request_log.select(F.window("ts", "1 hour")["start"].alias("window_start"), "handler", "duration_seconds")
    rank = log.join(merged, ["window_start", "handler"]).groupBy("window_start", "handler").agg(F.avg((F.col("duration_seconds") <= F.col("p95_s")).cast("int")).alias("up_to"), F.avg((F.col("duration_seconds") < F.col("p95_s")).cast("int")).alias("below"))
    told = merged.join(rank, ["window_start", "handler"]).withColumn("within", (F.col("up_to") >= 0.95 - 0.034) & (F.col("below") <= 0.95 + 0.034))
    return told.select("window_start", "handler", "n", "error_rate", "within")


@query("a30_log_filter", "SELECT event_id FROM request_log WHERE props LIKE '{%' AND regexp_matches(props, '(?i)[13579]')", "request_log")
def _(t):
    return kpi.log_filter(t.request_log, "[13579]").select("event_id")


# -- lists and paging ------------------------------------------------------------------


@query("l2_list_cases", "SELECT case_id FROM cases WHERE customer_region IN ('west', 'all') AND status IN ('open', 'acknowledged', 'in_progress') AND severity = 'high' ORDER BY created_at DESC, case_id DESC LIMIT 500", "cases")
def _(t):
    return serving.list_cases(t.cases, "west", severity="high", ceiling=500).select("case_id")


@query("l3_cases_page", f"p AS (SELECT case_id, updated_at FROM cases WHERE updated_at > TIMESTAMP '2024-01-01' OR true ORDER BY updated_at, case_id LIMIT 400), q AS (SELECT max(updated_at) AS u FROM p), r AS (SELECT max(case_id) AS i FROM p, q WHERE p.updated_at = q.u) SELECT case_id, {sec('updated_at')} AS updated_at FROM cases, q, r WHERE updated_at > u OR (updated_at = u AND case_id > i) ORDER BY updated_at, case_id LIMIT 400", "cases")
def _(t):
    _, cursor, _ = serving.cases_page(t.cases.select("case_id", "updated_at"), None, 400)
    return serving.cases_page(t.cases.select("case_id", "updated_at"), cursor, 400)[0]


@query("l4_cases_since", "SELECT case_id FROM cases WHERE updated_at > TIMESTAMP '1998-01-01'", "cases")
def _(t):
    import datetime as dt

    return serving.after(t.cases, (dt.datetime(1998, 1, 1, tzinfo=dt.timezone.utc), "~")).select("case_id")


@query("l6_pending_cases", f"SELECT case_id, {sec('created_at')} AS created_at FROM cases WHERE sf_sync_status = 'pending' ORDER BY created_at, case_id LIMIT 200", "cases")
def _(t):
    return serving.pending_cases(t.cases, 200).select("case_id", "created_at")


_PULL = "fleet AS (SELECT * FROM crm WHERE record_type = 'fleet' AND modstamp > TIMESTAMP '1995-01-01')"


@query("l10_crm_changes", f"{_PULL} SELECT salesforce_id, external_id, {sec('modstamp')} AS modstamp FROM fleet ORDER BY modstamp, coalesce(salesforce_id, external_id) LIMIT 200", "crm")
def _(t):
    return serving.crm_changes(t.crm, F.lit("1995-01-01 00:00:00").cast("timestamp")).select("salesforce_id", "external_id", "modstamp")


@query("t8_pull_watermark", f"{_PULL}, p AS (SELECT * FROM fleet ORDER BY modstamp, coalesce(salesforce_id, external_id) LIMIT 200) SELECT {sec('max(modstamp)')} AS watermark FROM p", "crm")
def _(t):
    from .streaming.jobs import pull_changes

    return pull_changes(t.crm, F.lit("1995-01-01 00:00:00").cast("timestamp"))[1]


# -- case fields -------------------------------------------------------------------------

_J = "json_extract_string(detection_facts, '$.{0}')"
_SUBJECT = f"""CASE case_type WHEN 'lost_signal' THEN concat('Lost signal during cruise — ', {_J.format('callsign')}, ' near ', s) WHEN 'diversion' THEN concat('Diversion — ', {_J.format('callsign')}, ' ', {_J.format('origin')}, '→', '?', ' (was ', '?', ')')
  WHEN 'excessive_hold' THEN concat('Excessive holding pattern — ', {_J.format('callsign')}, ' near ', s) WHEN 'weather_impact' THEN concat('Weather impact — ', s, ' (', {_J.format('flight_category')}, ')')
  WHEN 'go_around' THEN concat('Go-around — ', {_J.format('callsign')}, ' at ', s) ELSE concat('Delayed flight — ', {_J.format('callsign')}, ' ', {_J.format('origin')}, '→', {_J.format('destination')}) END"""


@query("p22_case_fields", f"c AS (SELECT *, CASE WHEN site_icao = '' THEN 'unknown site' ELSE site_icao END AS s FROM cases) SELECT case_id, {_SUBJECT} AS subject, CASE severity WHEN 'low' THEN 'Low' WHEN 'high' THEN 'High' WHEN 'critical' THEN 'High' ELSE 'Medium' END AS priority, upper(substr(customer_region, 1, 1)) || substr(customer_region, 2) AS region, round(({sec('resolved_at')} - {sec('created_at')}) / 3600.0, 6) AS hours FROM c", "cases")
def _(t):
    return t.cases.select("case_id", sc.case_subject("case_type", "site_icao", "detection_facts").alias("subject"), sc.to_priority("severity").alias("priority"), sc.region_title("customer_region").alias("region"), sc.resolution_hours("created_at", "resolved_at").alias("hours"))


@query("p43_case_violations", "SELECT case_id, 'resolve_requires_description' AS violation FROM cases WHERE status IN ('resolved', 'closed') AND summary IS NULL UNION ALL SELECT case_id, 'escalate_requires_justification' FROM cases WHERE status = 'escalated' AND length(coalesce(severity_justification, '')) < 10", "cases")
def _(t):
    return sc.case_violations(t.cases)


@query("p44_case_views", f"SELECT 'critical_open' AS view, case_id FROM cases WHERE severity = 'critical' AND {OPEN} UNION ALL SELECT 'recently_closed', case_id FROM cases WHERE NOT ({OPEN}) AND resolved_at >= {CASE_NOW} - INTERVAL 7 DAY UNION ALL SELECT 'rule:delay', case_id FROM cases WHERE case_type = 'delay' AND {OPEN} UNION ALL SELECT 'escalated', case_id FROM cases WHERE status = 'escalated'", "cases")
def _(t):
    from functools import reduce

    views = ("critical_open", "recently_closed", "rule:delay", "escalated")
    return reduce(DataFrame.unionByName, (sc.case_view(t.cases, v, now(t)).select(F.lit(v).alias("view"), "case_id") for v in views))


@query("p46_scalar_facts", f"SELECT case_id, {_J.format('callsign')} AS callsign, {_J.format('gap_minutes')} AS gap_minutes, CAST(8 AS BIGINT) AS n_facts FROM cases", "cases")
def _(t):
    facts = sc.scalar_facts("detection_facts")
    return t.cases.select("case_id", facts["callsign"].alias("callsign"), facts["gap_minutes"].alias("gap_minutes"), F.size(F.map_filter(facts, lambda k, v: k != "path")).alias("n_facts"))


@query("p27_flight_keys", f"SELECT flight_id, CASE WHEN flight_id LIKE 'bad%' THEN NULL ELSE icao24 END AS icao24, CASE WHEN flight_id LIKE 'bad%' THEN NULL ELSE {sec('takeoff_ts')} END AS takeoff FROM flights", "flights")
def _(t):
    k = sc.parse_flight_key("flight_id")
    return t.flights.select("flight_id", k["icao24"].alias("icao24"), k["takeoff"].alias("takeoff"))


@query("p20_case_rows", "SELECT flight_id, site_icao, coalesce(severity, 'low') AS severity, CASE WHEN severity = 'high' THEN 'pending' ELSE 'skipped' END AS sf_sync_status FROM cases", "cases")
def _(t):
    found = t.cases.select(F.col("flight_id").alias("icao24"), "site_icao", "customer_region", F.col("case_type").alias("rule"), "detection_facts", F.col("severity").alias("severity_hint"))
    return upserts.case_rows(found).select("flight_id", "site_icao", "severity", "sf_sync_status")


@query("p21_case_ids", "SELECT concat('CASE-2024-', lpad(CAST(row_number() OVER (ORDER BY created_at, case_id) + 99 AS STRING), 6, '0')) AS new_id, case_id AS old_id FROM cases", "cases")
def _(t):
    df = t.cases.select(F.col("case_id").alias("old_id"), "created_at")
    return sc.case_ids(df, 100, 2024, "created_at", "old_id").select(F.col("case_id").alias("new_id"), "old_id")


# -- joins ----------------------------------------------------------------------------------


@query("j11_runbooks", "r AS (SELECT t AS case_type, string_agg(runbook_id, ',' ORDER BY runbook_id) AS refs FROM (SELECT runbook_id, unnest(case_types) AS t FROM runbooks) GROUP BY t) SELECT case_id, coalesce(refs, '') AS runbook_refs FROM cases LEFT JOIN r USING (case_type)", "cases", "runbooks")
def _(t):
    return joins.with_runbooks(t.cases, t.runbooks).select("case_id", "runbook_refs")


_MATCH = "m AS (SELECT c.*, coalesce(a.case_id, b.case_id) AS matched FROM crm c LEFT JOIN cases a ON a.salesforce_id = c.salesforce_id LEFT JOIN cases b ON b.case_id = c.external_id)"


@query("j14_match_cases", f"{_MATCH} SELECT salesforce_id, external_id, matched AS case_id FROM m", "crm", "cases")
def _(t):
    return joins.match_cases(t.crm, t.cases).select("salesforce_id", "external_id", "case_id")


@query("a31_pull_summary", f"{_MATCH} SELECT count(*) AS fetched, count(matched) AS updated, count(*) - count(matched) AS unmatched FROM m", "crm", "cases")
def _(t):
    return kpi.pull_summary(joins.match_cases(t.crm, t.cases))


@query("j17_case_detail", f"SELECT case_id, count(event_id) AS n_events, {sec('max(occurred_at)')} AS last_event FROM cases LEFT JOIN timeline USING (case_id) GROUP BY case_id", "cases", "timeline")
def _(t):
    df = joins.case_detail(t.cases, t.timeline)
    return df.select("case_id", F.coalesce(F.size("events"), F.lit(0)).alias("n_events"), F.try_element_at("events", F.lit(-1))["occurred_at"].alias("last_event"))


@query(
    "j18_triage_tasks",
    f"""SELECT case_id, 'investigation' AS kind, count(*) AS n FROM cases JOIN (SELECT ct AS case_type, trim(unnest(string_split(triage_steps, chr(10)))) AS step FROM (SELECT unnest(case_types) AS ct, triage_steps FROM runbooks)) x USING (case_type) WHERE step <> '' AND NOT contains(step, '[Auto]') GROUP BY case_id
UNION ALL SELECT case_id, 'escalation', 1 FROM cases WHERE case_type = 'lost_signal' AND CAST({_J.format('gap_minutes')} AS DOUBLE) > 30 AND CAST({_J.format('last_altitude_ft')} AS DOUBLE) > 10000
UNION ALL SELECT case_id, 'notification', 1 FROM cases WHERE customer_region <> 'all'""",
    "cases",
    "runbooks",
)
def _(t):
    return joins.triage_tasks(t.cases, t.runbooks).groupBy("case_id", "kind").agg(F.count("*").alias("n"))


@query("j19_runbook_links", "d AS (SELECT runbook_id, unnest(case_types) AS case_type FROM runbooks WHERE runbook_id <> 'RB-1') SELECT case_id, concat('D', runbook_id) AS document_id FROM cases JOIN d USING (case_type) WHERE NOT (status = 'closed' AND runbook_id = 'RB-2')", "cases", "runbooks")
def _(t):
    documents = t.runbooks.filter("runbook_id <> 'RB-1'").select("title", F.concat(F.lit("D"), "runbook_id").alias("document_id"))
    existing = t.cases.filter("status = 'closed'").select("case_id", F.lit("DRB-2").alias("document_id"))
    return joins.runbook_links(t.cases, t.runbooks, documents, existing)


@query("j20_missing_sites", "SELECT DISTINCT site_icao AS icao FROM cases WHERE site_icao NOT IN (SELECT icao FROM airports WHERE is_watched)", "cases", "airports")
def _(t):
    return joins.missing_sites(t.cases.select(F.col("site_icao").alias("icao")).distinct(), t.airports.filter("is_watched"))


# -- stores ------------------------------------------------------------------------------------

_AIR = """air AS (SELECT icao24 FROM (SELECT icao24, on_ground, row_number() OVER (PARTITION BY icao24 ORDER BY ts_polled DESC, event_id DESC) AS n FROM positions) WHERE n = 1 AND NOT on_ground),
top AS (SELECT f.icao24, max(flight_id) AS flight_id FROM flights f SEMI JOIN air USING (icao24) WHERE flight_id NOT LIKE 'bad%' GROUP BY f.icao24)"""


def airborne(t: Tables) -> DataFrame:
    from .operators.windows import latest_per_key

    return latest_per_key(t.positions.withColumn("_e", -F.col("event_id")), ["icao24"], "ts_polled", "_e").drop("_e")


@query("x2_reconcile_flights", f"{_AIR} SELECT f.flight_id, CASE WHEN f.flight_id LIKE 'bad%' OR takeoff_ts >= TIMESTAMP '{START}' - INTERVAL 24 HOUR OR top.flight_id IS NOT NULL THEN 'keep' WHEN landed_at IS NOT NULL THEN 'completed' ELSE 'orphan' END AS fate FROM flights f LEFT JOIN top ON top.flight_id = f.flight_id", "flights", "positions")
def _(t):
    return stores.reconcile_flights(t.flights, airborne(t), F.lit(START).cast("timestamp")).select("flight_id", "fate")


@query("x3_liveness_delta", f"{_AIR}, target AS (SELECT flight_id FROM top WHERE flight_id NOT IN (SELECT flight_id FROM flights WHERE landed_at IS NOT NULL)), live AS (SELECT DISTINCT flight_id FROM flights WHERE is_live AND flight_id NOT LIKE 'bad%') SELECT flight_id, true AS is_live FROM target WHERE flight_id NOT IN (SELECT flight_id FROM live) UNION ALL SELECT flight_id, false FROM live WHERE flight_id NOT IN (SELECT flight_id FROM target)", "flights", "positions")
def _(t):
    return stores.liveness_delta(t.flights, airborne(t))


@query("x4_reconcile_cases", f"SELECT DISTINCT external_id AS case_id FROM crm WHERE external_id IS NOT NULL AND external_id NOT IN (SELECT case_id FROM cases WHERE {OPEN})", "crm", "cases")
def _(t):
    return stores.reconcile(t.crm.filter("external_id is not null").select(F.col("external_id").alias("case_id")), kpi.open_cases(t.cases), "case_id")


@query("x5_archive_candidates", f"SELECT flight_id, {sec('landed_at')} AS landed_at FROM flights WHERE landed_at <= TIMESTAMP '{START}' - INTERVAL 2 HOUR ORDER BY landed_at, flight_id LIMIT 1000", "flights")
def _(t):
    return stores.archive_candidates(t.flights, F.lit(START).cast("timestamp"), cap=1000).select("flight_id", "landed_at")


@query("x9_past_retention", f"SELECT count(*) AS past_retention FROM flights WHERE landed_at < TIMESTAMP '{START}' - INTERVAL 1 DAY", "flights")
def _(t):
    return stores.check_past_retention(t.flights, F.lit(START).cast("timestamp"), 1)


@query("x10_disjoint", "SELECT count(DISTINCT flight_id) AS in_both FROM flights WHERE landed_at IS NOT NULL AND flight_id IN (SELECT flight_id FROM flights WHERE is_live)", "flights")
def _(t):
    return stores.check_disjoint(t.flights.filter("landed_at is not null"), t.flights.filter("is_live")).drop("sample")


@query("x18_classify_flights", f"SELECT count(*) AS n, count(*) FILTER (WHERE landed_at IS NOT NULL) AS completed, count(*) FILTER (WHERE is_live) AS live, count(*) FILTER (WHERE flight_id LIKE 'bad%') AS malformed FROM flights", "flights")
def _(t):
    df = stores.classify_flights(t.flights, F.lit(START).cast("timestamp"))
    return df.agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("completed", "live", "malformed")))


@query("l7_cap_deletes", f"SELECT count(DISTINCT flight_id) AS orphans, least(count(DISTINCT flight_id), 100) AS deleted, greatest(count(DISTINCT flight_id) - 100, 0) AS remaining FROM flights WHERE landed_at IS NULL", "flights")
def _(t):
    return serving.cap_deletes(t.flights.filter("landed_at is null").select("flight_id").distinct(), "flight_id", 100)[1]


_OUT = "o AS (SELECT *, CASE CAST(substr(case_id, 11) AS BIGINT) % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'permanent' ELSE 'transient' END AS outcome FROM cases WHERE sf_sync_status = 'pending'), r AS (SELECT *, CASE WHEN outcome IN ('success', 'duplicate') THEN 'synced' WHEN outcome = 'permanent' OR sf_sync_attempts + 1 >= 5 THEN 'failed' ELSE 'retrying' END AS result FROM o)"


def outcomes(t: Tables) -> DataFrame:
    number = F.substring("case_id", 11, 20).cast("long") % 5
    outcome = F.when(number == 0, "success").when(number == 1, "duplicate").when(number == 2, "permanent").otherwise("transient")
    return t.cases.filter("sf_sync_status = 'pending'").select("case_id", outcome.alias("outcome"), F.concat(F.lit("new"), "case_id").alias("salesforce_id"), F.lit("busy").alias("error"))


@query("x12_push_outcomes", f"{_OUT} SELECT c.case_id, coalesce(CASE r.result WHEN 'retrying' THEN 'pending' ELSE r.result END, c.sf_sync_status) AS sf_sync_status, {long('CASE WHEN r.case_id IS NULL THEN c.sf_sync_attempts ELSE c.sf_sync_attempts + 1 END')} AS sf_sync_attempts, CASE WHEN r.result = 'synced' THEN concat('new', c.case_id) ELSE c.salesforce_id END AS salesforce_id FROM cases c LEFT JOIN r USING (case_id)", "cases")
def _(t):
    return stores.apply_push_outcomes(t.cases, outcomes(t), now(t))[0].select("case_id", "sf_sync_status", "sf_sync_attempts", "salesforce_id")


@query("a31_sync_summary", f"{_OUT} SELECT count(*) AS attempted, count(*) FILTER (WHERE result = 'synced') AS synced, count(*) FILTER (WHERE result = 'retrying') AS retrying, count(*) FILTER (WHERE result = 'failed') AS failed FROM r", "cases")
def _(t):
    return kpi.sync_summary(stores.apply_push_outcomes(t.cases, outcomes(t), now(t))[1])


_CRM = f"""{_MATCH}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY matched ORDER BY modstamp DESC, coalesce(salesforce_id, '') DESC) AS k FROM m WHERE matched IS NOT NULL) WHERE k = 1),
n AS (SELECT c.case_id, o.matched IS NOT NULL AS hit, c.status AS old_status, c.severity AS old_severity, c.resolved_at AS old_resolved, c.salesforce_id AS old_id, c.summary AS old_summary, o.summary AS new_summary, o.resolved_at AS new_resolved, o.salesforce_id AS new_id,
  CASE o.crm_status WHEN 'Closed' THEN 'closed' WHEN 'Working' THEN 'in_progress' WHEN 'Escalated' THEN 'escalated' ELSE 'open' END AS new_status, CASE o.priority WHEN 'High' THEN 'high' WHEN 'Low' THEN 'low' END AS new_severity FROM cases c LEFT JOIN one o ON o.matched = c.case_id)"""


@query("x13_crm_pull", f"{_CRM} SELECT case_id, CASE WHEN hit THEN new_status ELSE old_status END AS status, coalesce(new_severity, old_severity) AS severity, coalesce(new_summary, old_summary) AS summary, coalesce(old_id, new_id) AS salesforce_id, {sec('CASE WHEN hit THEN new_resolved ELSE old_resolved END')} AS resolved_at FROM n", "crm", "cases")
def _(t):
    return stores.apply_crm_changes(t.cases, t.crm)[0].select("case_id", "status", "severity", "summary", "salesforce_id", "resolved_at")


@query("w7_material_changes", f"{_CRM} SELECT case_id, 'status_changed' AS event_type FROM n WHERE hit AND new_status <> old_status UNION ALL SELECT case_id, 'severity_changed' FROM n WHERE hit AND new_severity IS NOT NULL AND new_severity IS DISTINCT FROM old_severity UNION ALL SELECT case_id, 'resolved' FROM n WHERE hit AND new_resolved IS NOT NULL AND old_resolved IS NULL", "crm", "cases")
def _(t):
    return stores.apply_crm_changes(t.cases, t.crm)[1].select("case_id", "event_type")


_CASE_TIMES = ("created_at", "updated_at", "resolved_at")


@query("x14_mirror_cases", f"c AS (SELECT *, CASE WHEN site_icao = '' THEN 'unknown site' ELSE site_icao END AS s FROM cases) SELECT * EXCLUDE (s, sf_sync_attempts, {', '.join(_CASE_TIMES)}), {long('sf_sync_attempts')} AS sf_sync_attempts, {', '.join(f'{sec(c)} AS {c}' for c in _CASE_TIMES)}, {_SUBJECT} AS subject FROM c", "cases")
def _(t):
    return stores.mirror_cases(t.cases)


@query("s20_upsert_by_key", "SELECT flight_id, site_icao, case_id FROM cases WHERE case_id NOT IN (SELECT external_id FROM crm WHERE external_id IS NOT NULL) UNION ALL SELECT 'x', 'y', external_id FROM crm WHERE external_id IS NOT NULL", "cases", "crm")
def _(t):
    batch = t.crm.filter("external_id is not null").select(F.lit("x").alias("flight_id"), F.lit("y").alias("site_icao"), F.col("external_id").alias("case_id"))
    return upserts.overwrite_by_key(t.cases.select("flight_id", "site_icao", "case_id"), batch, ["case_id"])


@query("s27_patch_rows", f"SELECT f.flight_id, {sec('f.takeoff_ts')} AS takeoff_ts, CASE WHEN f.flight_id LIKE 'bad%' THEN false ELSE f.is_live END AS is_live FROM (SELECT DISTINCT flight_id, min(takeoff_ts) AS takeoff_ts, bool_or(is_live) AS is_live FROM flights GROUP BY flight_id) f", "flights")
def _(t):
    one = t.flights.groupBy("flight_id").agg(F.min("takeoff_ts").alias("takeoff_ts"), F.bool_or("is_live").alias("is_live"))
    return upserts.patch_rows(one, one.filter("flight_id like 'bad%'").select("flight_id", F.lit(False).alias("is_live")), ["flight_id"])


@query("s28_export_crm", None)
def _(t):
    return exports.export_crm_cases(t.cases, 500)


@query("s26_export_cases", None)
def _(t):
    return exports.export_objects(t.cases, "case")


_ARCHIVED = {"callsign": "concat('C', icao24)", "registration": "CASE WHEN is_live THEN concat('N', icao24) END", "aircraft_type": "'B738'", "operator_icao": "upper(icao24)", "customer_region": "'west'", "origin_icao": "concat('K', icao24)", "destination_icao": "substr(flight_id, 2)", "status": "'landed'", "current_stage": "CASE WHEN is_live THEN 'landed' ELSE 'parked' END", "open_case_ids": "'[]'", "status_timeline": "concat('[', flight_id, ']')", "trail_2h": "'{}'"}
_NUMBERS = {"eta_minutes": ("CAST(length(flight_id) AS STRING)", "BIGINT"), "lat": ("CASE WHEN is_live THEN '12.5' ELSE 'north' END", "DOUBLE"), "lon": ("'-7.25'", "DOUBLE"), "open_case_count": ("CASE WHEN is_live THEN '' ELSE '3' END", "BIGINT")}


@query("x6_archive_rows", f"SELECT flight_id, icao24, {', '.join(f'{v} AS {k}' for k, v in _ARCHIVED.items())}, {', '.join(f'TRY_CAST({v} AS {kind}) AS {k}' for k, (v, kind) in _NUMBERS.items())}, {sec('takeoff_ts')} AS takeoff_ts, {sec('landed_at')} AS landed_at, {sec(f"TIMESTAMP '{START}'")} AS archived_at FROM flights WHERE landed_at IS NOT NULL", "flights")
def _(t):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rest = {**_ARCHIVED, **{k: v for k, (v, _) in _NUMBERS.items()}}
    raw = t.flights.filter("landed_at is not null").select(F.col("flight_id").alias("flightId"), "icao24", iso("takeoff_ts").alias("takeoffTs"), iso("landed_at").alias("landedAt"), *(F.expr(v).alias("trail2h" if k == "trail_2h" else exports.camel(k)) for k, v in rest.items()))
    return stores.to_archive_rows(raw, F.lit(START))


@query("s21_upsert_flight_plans", f"SELECT icao24, fetch_status, {sec('refreshed_at')} AS refreshed_at FROM plans WHERE icao24 NOT IN (SELECT icao24 FROM registry WHERE aircraft_type IS NULL) UNION ALL SELECT icao24, 'not_found', NULL FROM registry WHERE aircraft_type IS NULL", "plans", "registry")
def _(t):
    stored = t.plans.select("icao24", "fetch_status", "refreshed_at")
    fetched = t.registry.filter("aircraft_type is null").select("icao24", F.lit("not_found").alias("fetch_status"), F.lit(None).cast("timestamp").alias("refreshed_at"))
    return upserts.upsert_flight_plans(stored, fetched)


@query("w6_latest_leg", f"h AS (SELECT *, coalesce(landed_at, takeoff_ts) AS last_seen FROM flights) SELECT icao24, {sec('max(last_seen)')} AS last_seen, {sec('arg_max(takeoff_ts, struct_pack(a := last_seen, b := takeoff_ts))')} AS first_seen FROM h WHERE last_seen >= TIMESTAMP '2023-12-30 06:00:00' AND takeoff_ts <= TIMESTAMP '2023-12-31 18:00:00' GROUP BY icao24", "flights")
def _(t):
    from .operators.windows import latest_leg

    none = F.lit(None).cast("string")
    history = t.flights.select("icao24", F.col("takeoff_ts").alias("first_seen"), F.coalesce("landed_at", "takeoff_ts").alias("last_seen"), none.alias("callsign"), none.alias("origin_icao"), none.alias("destination_icao"))
    at = lambda s: F.lit(s).cast("timestamp")
    return latest_leg(history, at("2023-12-30 06:00:00"), at("2023-12-31 18:00:00")).select("icao24", "last_seen", "first_seen")


@query("p48_triage_eligible", "SELECT case_id FROM cases WHERE customer_region <> 'all' AND severity_justification IS NULL", "cases")
def _(t):
    marked = t.cases.withColumn("record_type", F.when(F.col("customer_region") != "all", "fleet").otherwise("other"))
    return sc.triage_eligible(marked).select("case_id")


@query("p26_ref_lists", "SELECT case_id, concat(case_type, ',', status) AS refs FROM cases", "cases")
def _(t):
    text = F.concat(F.lit(" "), "case_type", F.lit(", ,"), "status", F.lit(" ,"))
    return t.cases.select("case_id", sc.split_refs(text).alias("refs"))


@query("p24_crm_fields", "SELECT external_id, CASE crm_status WHEN 'Closed' THEN 'closed' WHEN 'Working' THEN 'in_progress' WHEN 'Escalated' THEN 'escalated' ELSE 'open' END AS status, CASE priority WHEN 'High' THEN 'high' WHEN 'Low' THEN 'low' END AS severity FROM crm", "crm")
def _(t):
    return t.crm.select("external_id", sc.from_crm_status("crm_status").alias("status"), sc.from_priority("priority").alias("severity"))
