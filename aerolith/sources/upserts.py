"""Keyed upserts as frames (S19 to S24, S27, T2): the caller writes the result to a new version.

Spark reads and writes are never on one path: ``swap`` writes a version folder and returns it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_wins(target: DataFrame | None, batch: DataFrame, keys: list[str], ts: str, first_not_null: tuple[str, ...] = ()) -> DataFrame:
    """Of each key the row with the newest ``ts``; on a tie the stored row stays.

    ``first_not_null`` columns keep the value that was known first.
    """
    rows = batch.withColumn("_new", F.lit(1))
    if target is not None:
        rows = target.withColumn("_new", F.lit(0)).unionByName(rows)
    values = [c for c in rows.columns if c not in (*keys, "_new")]
    order = F.struct(F.col(ts), -F.col("_new"))
    best = [F.max_by(F.struct(*values), order).alias("_best")]
    # the first known value: stored before new, then by time
    early = [F.min_by(F.struct(F.col(c)), F.when(F.col(c).isNotNull(), F.struct("_new", ts))).alias(f"_{c}") for c in first_not_null]
    out = rows.groupBy(*keys).agg(*best, *early)
    return out.select(*keys, *((F.col(f"_{c}")[c] if c in first_not_null else F.col("_best")[c]).alias(c) for c in values))


def upsert_positions(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Last known state: newest event time wins, aircraft_type is the first known."""
    return newest_wins(target, batch, ["icao24"], "last_seen_at", ("aircraft_type",) if "aircraft_type" in batch.columns else ())


def overwrite_by_key(target: DataFrame, batch: DataFrame, keys: list[str], ts: str | None = None) -> DataFrame:
    """Rows of ``batch`` replace the target's rows of the same key.

    A key that the batch repeats gives one row: the newest by ``ts``, then the largest by all values.
    """
    values = [c for c in batch.columns if c not in keys]
    order = F.struct(*([ts] if ts else []), *values)
    once = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, *(F.col("_v")[c].alias(c) for c in values))
    return target.join(once.select(*keys), keys, "left_anti").unionByName(once.select(*batch.columns))


def upsert_conditions(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Site weather: the batch's row replaces the site's, the newest observation if it has several."""
    return overwrite_by_key(target, batch, ["site_icao"], "metar_observed_at" if "metar_observed_at" in batch.columns else None)


def upsert_flight_plans(target: DataFrame, fetched: DataFrame) -> DataFrame:
    """Flight plans by aircraft with their outcome: success, not_found or error; another status fails the query."""
    known = F.col("fetch_status").isin("success", "not_found", "error")
    bad = F.raise_error(F.concat(F.lit("unknown fetch status: "), F.coalesce("fetch_status", F.lit("null")))).cast("string")
    return overwrite_by_key(target, fetched.withColumn("fetch_status", F.when(known, F.col("fetch_status")).otherwise(bad)), ["icao24"])


def upsert_airports(target: DataFrame, batch: DataFrame, root: str) -> DataFrame:
    """Airports by ICAO, written as a new version; it must hold every ICAO of both sides once."""
    new = overwrite_by_key(target, batch, ["icao"])
    expected = target.select("icao").unionByName(batch.select("icao")).distinct().count()
    return check_count(new.sparkSession.read.parquet(swap(new, root)), expected)


def patch_rows(target: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Only columns that the patch has, and only its non-null values, change."""
    renamed = patch.select(*keys, *(F.col(c).alias(f"_{c}") for c in patch.columns if c not in keys))
    new: dict[str, Column] = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in patch.columns if c not in keys}
    return target.join(renamed, keys, "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in target.columns))


def check_count(df: DataFrame, expected: int) -> DataFrame:
    """``df``, or an error if it has not ``expected`` rows."""
    if (n := df.count()) != expected:
        raise ValueError(f"{n} rows after the load, {expected} expected")
    return df


def swap(df: DataFrame, root: str) -> str:
    """Write a new version under ``root`` and return its path."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def replace_registry(df: DataFrame, root: str) -> str:
    path = swap(df, root)
    check_count(df.sparkSession.read.parquet(path), df.count())
    return path


def case_rows(anomalies: DataFrame) -> DataFrame:
    """Anomalies as case rows: site sentinel, low as default severity, push gate (P20)."""
    severity = F.coalesce("severity_hint", F.lit("low"))
    return anomalies.select(
        F.coalesce(F.nullif("icao24", F.lit("")), F.concat(F.lit("WX-"), F.coalesce("site_icao", F.lit("UNKN")))).alias("flight_id"),
        F.coalesce("site_icao", F.lit("")).alias("site_icao"),
        "customer_region",
        F.col("rule").alias("case_type"),
        F.lit("open").alias("status"),
        severity.alias("severity"),
        "detection_facts",
        F.when(severity == "high", "pending").otherwise("skipped").alias("sf_sync_status"),
    )


def append_cases(cases: DataFrame, case_root: str, timeline_root: str, now: Column) -> None:
    """Append cases and their first timeline rows; cases are written first and read back for the timeline."""
    path = swap(cases.withColumns({"created_at": now, "updated_at": now}), case_root)
    stored = cases.sparkSession.read.parquet(path)
    stored.select("case_id", F.lit("created").alias("event_type"), F.col("detection_facts").alias("detail"), F.lit("detector").alias("source"), F.col("created_at").alias("occurred_at")).write.mode("append").parquet(timeline_root)
