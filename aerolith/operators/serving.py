"""Scoped lists, paging and limits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import scalars as sc

CEILING = 50_000


def _newest(df: DataFrame, order: list[Column], ceiling: int | None) -> DataFrame:
    """The first ``ceiling`` rows with ``truncated``: one row more is asked for and shows a clipped result.  Without a ceiling, all."""
    from pyspark.sql import Window

    if ceiling is None:
        return df.orderBy(*order).withColumn("truncated", F.lit(False))
    some = df.orderBy(*order).limit(ceiling + 1)  # top-k per task, then one merge of at most ceiling rows each
    w = Window.orderBy(*order)
    some = some.withColumns({"_n": F.row_number().over(w), "truncated": F.count("*").over(Window.partitionBy(F.lit(1))) > ceiling})
    return some.filter(F.col("_n") <= ceiling).drop("_n")


def live_positions(current: DataFrame, now: Column, scope: str = "all", region: str | None = None, bbox: tuple[float, float, float, float] | None = None, ceiling: int | None = CEILING) -> DataFrame:
    """Aircraft seen in 15 minutes, newest first, with staleness (L1)."""
    df = sc.seen_within(sc.scope_positions(current, scope, region), 15, now)
    df = df if bbox is None else geo.in_bbox(df, *bbox)
    df = _newest(df, [F.desc("last_seen_at"), F.asc("icao24")], ceiling)
    return df.withColumns({"staleness": sc.staleness("last_seen_at", now), "pipeline_lag_seconds": sc.epoch(now) - F.max(sc.epoch("last_seen_at")).over(_all())})


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def list_cases(cases: DataFrame, scope: str = "all", statuses=sc.OPEN_STATUSES, severity: str | None = None, site: str | None = None, ceiling: int = CEILING) -> DataFrame:
    """Cases newest first (L2)."""
    return _newest(sc.filter_cases(sc.scope_cases(cases, scope), statuses, severity, site), [F.desc("created_at"), F.desc("case_id")], ceiling)


def after(df: DataFrame, cursor: tuple[dt.datetime, str] | None) -> DataFrame:
    """Rows after the keyset cursor (updated_at, case_id): ties are neither skipped nor sent twice (L4)."""
    if cursor is None:
        return df
    at = F.lit(cursor[0]).cast("timestamp")
    return df.filter((F.col("updated_at") > at) | ((F.col("updated_at") == at) & (F.col("case_id") > cursor[1])))


def cases_page(cases: DataFrame, cursor: tuple[dt.datetime, str] | None, limit: int) -> tuple[DataFrame, tuple[dt.datetime, str] | None, bool]:
    """A page, the next cursor, and whether the page is full (L3)."""
    page = after(cases, cursor).orderBy("updated_at", "case_id").limit(limit)
    last = page.agg(F.max(F.struct("updated_at", "case_id")).alias("c"), F.count("*").alias("n")).first()
    return page, (tuple(last["c"]) if last["n"] else cursor), last["n"] == limit


def drain(cases: DataFrame, cursor: tuple[dt.datetime, str] | None) -> tuple[DataFrame, DataFrame]:
    """All rows after the cursor in page order, and one row with the final cursor and how many there were (L4).

    This is what all pages give one after another: the order is total, so one keyset filter and one
    maximum replace the loop.  Without rows the cursor stays.
    """
    rows = after(cases, cursor)
    last = rows.agg(F.max(F.struct("updated_at", "case_id")).alias("c"), F.count("*").alias("n"))
    at = (F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])) if cursor else (F.lit(None).cast("timestamp"), F.lit(None).cast("string"))
    return rows.orderBy("updated_at", "case_id"), last.select(F.coalesce("c.updated_at", at[0]).alias("updated_at"), F.coalesce("c.case_id", at[1]).alias("case_id"), "n")


def site_flow(current: DataFrame, icao: str, direction: str, now: Column, limit: int | None = 500) -> DataFrame:
    """Aircraft bound for or from a site in the last hour, newest first (L5); all of them without a ``limit``."""
    end = {"inbound": "destination_icao", "outbound": "origin_icao"}[direction]
    df = sc.seen_within(current, 60, now).filter(F.col(end) == icao.upper()).orderBy(F.desc("last_seen_at"), "icao24")
    return df if limit is None else df.limit(limit)


def pending_cases(cases: DataFrame, n: int) -> DataFrame:
    return cases.filter("sf_sync_status = 'pending'").orderBy("created_at", "case_id").limit(n)


def cap_deletes(orphans: DataFrame, key: str, n: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` keys in order, and one row with how many are deleted and remain."""
    total = orphans.agg(F.count("*").alias("orphans"))
    counts = total.select("orphans", F.least("orphans", F.lit(n)).alias("deleted"), F.greatest(F.col("orphans") - n, F.lit(0)).alias("remaining"))
    return orphans.orderBy(key).limit(n), counts


def list_sites(sites: DataFrame, scope: str = "all", region: str | None = None) -> DataFrame:
    """Watched sites by ICAO; ``in_scope`` only informs."""
    df = sites.filter("is_watched")
    df = df if region is None else df.filter(F.array_contains("customer_regions", region))
    return df.withColumn("in_scope", F.coalesce(sc.site_in_scope("customer_regions", scope), F.lit(False))).orderBy("icao")


def crm_changes(crm: DataFrame, watermark: Column, limit: int = 200) -> DataFrame:
    """Changed fleet records after the watermark, oldest first."""
    return crm.filter((F.col("record_type") == "fleet") & (F.col("modstamp") > watermark)).orderBy("modstamp", F.coalesce("salesforce_id", "external_id")).limit(limit)
