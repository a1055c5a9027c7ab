"""Consistency between stores: reconcile, archive, sync."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..sources import lake
from .joins import match_cases, merge_site
from .windows import latest_flight, material_changes


def _guarded(orphans: DataFrame, live: DataFrame) -> DataFrame:
    """No orphans at all while the live side is empty: an empty feed says nothing about the fleet."""
    some = live.limit(1).agg(F.count("*").alias("_live"))
    return orphans.crossJoin(F.broadcast(some)).filter("_live > 0").drop("_live")  # one row


def reconcile(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Stored keys without a live one."""
    return _guarded(stored.select(key).distinct().join(live.select(key).distinct(), key, "left_anti"), live)


def classify_flights(stored: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """``stored`` with flags completed, live, malformed, recent."""
    parsed = sc.parse_flight_key("flight_id")
    df = stored.withColumn("_k", parsed)
    return df.withColumns(
        {
            "completed": F.col("landed_at").isNotNull(),
            "live": F.coalesce("is_live", F.lit(False)),
            "malformed": F.col("_k").isNull(),
            "recent": F.coalesce(F.col("_k.takeoff") >= now - F.expr(f"interval {int(ttl_hours)} hours"), F.lit(False)),
        }
    ).drop("_k")


def latest_airborne(stored: DataFrame, positions: DataFrame) -> DataFrame:
    """Latest flight of each aircraft that is airborne now."""
    return latest_flight(stored).join(positions.filter(~F.col("on_ground")).select("icao24").distinct(), "icao24", "left_semi")


def reconcile_flights(stored: DataFrame, positions: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """``stored`` flights with ``fate``: keep, completed (left for the archive) or orphan.

    Kept are each airborne aircraft's latest flight, takeoffs of the last ``ttl_hours`` and keys that
    can't be read.  Without any airborne aircraft everything is kept.
    """
    live = latest_airborne(stored, positions)
    df = classify_flights(stored, now, ttl_hours).join(live.select("flight_id", F.lit(True).alias("_top")), "flight_id", "left")
    some = positions.filter(~F.col("on_ground")).limit(1).agg(F.count("*").alias("_live"))
    keep = F.col("malformed") | F.col("recent") | F.coalesce("_top", F.lit(False)) | (F.col("_live") == 0)
    fate = F.when(keep, "keep").when(F.col("completed"), "completed").otherwise("orphan")
    return df.crossJoin(F.broadcast(some)).withColumn("fate", fate).drop("_top", "_live")  # one row


def liveness_delta(stored: DataFrame, positions: DataFrame) -> DataFrame:
    """``flight_id, is_live`` to write: only what differs from the stored flag."""
    done = stored.filter("landed_at is not null").select("flight_id")
    target = latest_airborne(stored, positions).join(done, "flight_id", "left_anti").select("flight_id").distinct()
    current = stored.filter("is_live").filter(sc.parse_flight_key("flight_id").isNotNull()).select("flight_id").distinct()
    on = target.join(current, "flight_id", "left_anti").withColumn("is_live", F.lit(True))
    return on.unionByName(current.join(target, "flight_id", "left_anti").withColumn("is_live", F.lit(False)))


def archive_candidates(flights: DataFrame, now: Column, grace_hours: int = 2, cap: int | None = 5_000) -> DataFrame:
    """Completed flights that landed ``grace_hours`` ago or earlier, oldest first up to ``cap``."""
    df = flights.filter(F.col("landed_at") <= now - F.expr(f"interval {int(grace_hours)} hours"))
    return df if cap is None else df.orderBy("landed_at", "flight_id").limit(cap)


def to_archive_rows(flights: DataFrame, run_at: Column) -> DataFrame:
    """Camel-case flight objects to archive rows."""
    text = lambda c: F.col(c).cast("string")
    names = {"flight_id": "flightId", "icao24": "icao24", "callsign": "callsign", "registration": "registration", "aircraft_type": "aircraftType", "operator_icao": "operatorIcao", "customer_region": "customerRegion", "origin_icao": "originIcao", "destination_icao": "destinationIcao", "status": "status", "current_stage": "currentStage", "open_case_ids": "openCaseIds", "status_timeline": "statusTimeline", "trail_2h": "trail2h"}
    there = set(flights.columns)
    out = [(text(v) if v in there else F.lit(None).cast("string")).alias(k) for k, v in names.items()]
    numbers = {"eta_minutes": ("etaMinutes", "int"), "lat": ("lat", "double"), "lon": ("lon", "double"), "open_case_count": ("openCaseCount", "int")}
    out += [(F.col(v).try_cast(t) if v in there else F.lit(None).cast(t)).alias(k) for k, (v, t) in numbers.items()]
    return flights.select(*out, sc.to_utc("takeoffTs").alias("takeoff_ts"), sc.to_utc("landedAt").alias("landed_at"), run_at.cast("timestamp").alias("archived_at"))


def archive_verify_delete(spark: SparkSession, rows: DataFrame, root: str, archived_at: dt.datetime) -> DataFrame:
    """Write archive rows, read this run's rows back, and return the ids that may be deleted.

    Raises before anything can be deleted if a written id can't be read back.  A run that is started again, with
    the same ``archived_at``, writes and returns the same; of a later run over rows that an earlier one has
    archived but not deleted, each flight is read once.
    """
    lake.write_flights_archive(rows.withColumn("archived_at", F.lit(archived_at).cast("timestamp")), root)
    back = lake.read_flights_archive(spark, root, columns=["flight_id"], run_at=archived_at)
    missing = rows.select("flight_id").join(back, "flight_id", "left_anti")
    if (n := missing.count()) > 0:
        raise RuntimeError(f"{n} archived flights can't be read back; nothing is deleted")
    return back


def check_rowcount(spark: SparkSession, root: str, archived_at: dt.datetime, n: int) -> bool:
    return lake.archive_count_at(spark, root, archived_at) == n


def check_past_retention(flights: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return flights.agg(F.count_if(F.col("landed_at") < now - F.expr(f"interval {int(days)} days")).alias("past_retention"))


def check_disjoint(archive: DataFrame, live: DataFrame, sample: int = 10) -> DataFrame:
    """One row: how many keys are in both stores, and the first few of them."""
    both = archive.select("flight_id").join(live.select("flight_id"), "flight_id", "left_semi").distinct()
    few = both.orderBy("flight_id").limit(sample).agg(F.sort_array(F.collect_list("flight_id")).alias("sample"))
    return both.agg(F.count("*").alias("in_both")).crossJoin(few)  # one row by one row


def check_retention(spark: SparkSession, root: str, today: dt.date, days: int = 30) -> bool:
    oldest = lake.oldest_partition(spark, root)
    return oldest is None or oldest >= today - dt.timedelta(days=days)


def apply_push_outcomes(cases: DataFrame, outcomes: DataFrame, now: Column, max_attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """Cases after a push, and one timeline row an outcome.

    ``outcomes(case_id, outcome, salesforce_id, error)``; outcome is success, duplicate (the existing
    record is adopted), transient or permanent.
    """
    o = outcomes.select("case_id", "outcome", F.col("salesforce_id").alias("_sf"), F.col("error").alias("_error"))
    df = cases.join(o, "case_id", "left")
    attempts = F.coalesce("sf_sync_attempts", F.lit(0)) + 1
    good = F.col("outcome").isin("success", "duplicate")
    failed = (F.col("outcome") == "permanent") | ((F.col("outcome") == "transient") & (attempts >= max_attempts))
    result = F.when(good, "synced").when(failed, "failed").when(F.col("outcome").isNotNull(), "retrying")
    df = df.withColumns({"result": result, "_attempts": attempts})
    hit = F.col("result").isNotNull()
    new = df.withColumns(
        {
            "salesforce_id": F.when(F.col("result") == "synced", F.coalesce("_sf", "salesforce_id")).otherwise(F.col("salesforce_id")),
            "sf_sync_status": F.when(F.col("result") == "retrying", "pending").otherwise(F.coalesce("result", "sf_sync_status")),
            "sf_sync_attempts": F.when(hit, F.col("_attempts")).otherwise(F.col("sf_sync_attempts")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    )
    names = {"synced": "sf_synced", "retrying": "sf_sync_retry", "failed": "sf_sync_failed"}
    detail = F.when(F.col("result") == "synced", F.to_json(F.struct(F.coalesce("_sf", "salesforce_id").alias("salesforce_id")))).otherwise(F.to_json(F.struct(F.col("_attempts").alias("attempts"), F.col("_error").alias("error"))))
    timeline = df.filter(hit).select("case_id", sc.lookup("result", names).alias("event_type"), detail.alias("detail"), F.lit("sf_sync").alias("source"), now.alias("occurred_at"), "result")
    return new.drop("outcome", "_sf", "_error", "_attempts", "result"), timeline


def apply_crm_changes(cases: DataFrame, crm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases after a CRM pull, and their material changes.

    The newest change of a case counts.  A null text never blanks a stored one; status and resolved_at
    are the CRM's; a missing CRM id is filled in.
    """
    found = match_cases(crm, cases).filter("case_id is not null")
    found = found.groupBy("case_id").agg(F.max_by(F.struct("salesforce_id", "crm_status", "priority", "summary", "resolved_at"), F.struct("modstamp", F.coalesce("salesforce_id", F.lit("")))).alias("c"))
    df = cases.join(found, "case_id", "left")
    hit = F.col("c").isNotNull()
    pick = lambda new, old: F.when(hit, new).otherwise(F.col(old))
    severity = sc.from_priority("c.priority")
    df = df.withColumns(
        {
            "new_status": pick(sc.from_crm_status("c.crm_status"), "status"),
            "new_severity": severity,
            "new_resolved_at": pick(F.col("c.resolved_at"), "resolved_at"),
            "old_status": F.col("status"),
            "old_severity": F.col("severity"),
            "old_resolved_at": F.col("resolved_at"),
        }
    )
    events = material_changes(df.filter(hit))
    new = df.withColumns({"status": F.col("new_status"), "severity": F.coalesce("new_severity", "severity"), "summary": F.coalesce("c.summary", "summary"), "resolved_at": F.col("new_resolved_at"), "salesforce_id": F.coalesce("salesforce_id", "c.salesforce_id")})
    return new.select(*cases.columns), events


def mirror_cases(cases: DataFrame) -> DataFrame:
    """Case objects: every field and the subject."""
    return cases.withColumn("subject", sc.case_subject("case_type", "site_icao", "detection_facts"))


def prune_current(current: DataFrame, now: Column, hours: int = 3) -> DataFrame:
    return current.filter(F.col("last_seen_at") >= now - F.expr(f"interval {int(hours)} hours"))


def mirror_aircraft(current: DataFrame, now: Column) -> DataFrame:
    cols = ["icao24", "callsign", "lat", "lon", "altitude_ft", "speed_kt", "heading_deg", "vertical_rate_fpm", "on_ground", "customer_region", "last_seen_at"]
    return current.select(*cols, sc.staleness("last_seen_at", now).alias("staleness"))


def mirror_sites(sites: DataFrame, sla: DataFrame) -> DataFrame:
    """Every watched site's detail with its scorecard; a site without one stays, with nulls."""
    return merge_site(sites.filter("is_watched"), sla)


def enrich_flights(flights: DataFrame, detail: DataFrame, trails: DataFrame) -> DataFrame:
    """Each aircraft's latest flight with its detail and trail; aircraft without detail are skipped."""
    out = latest_flight(flights).join(detail, "icao24").join(trails, "icao24", "left")
    return out.withColumns({"status": sc.flight_status("status_timeline"), "current_stage": sc.current_stage("status_timeline"), "landed_at": sc.landed_at("status_timeline")}) if "status_timeline" in detail.columns else out
