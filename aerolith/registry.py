"""Registering queries over the fleet tables together with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Fleet tables by name over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in adapters.VIEWS:
            return adapters.view(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    def latest(self, table: str, ts: str) -> Column:
        """Newest time of a table, as a subquery of the plan: what is 'now' for its queries."""
        return getattr(self, table).agg(F.max(ts).cast("timestamp")).scalar()


def flat(df: DataFrame) -> DataFrame:
    """Plain result columns: times as epoch seconds, whole numbers as long, lists as text, doubles to 6 places."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("timestamp"):
            c = F.unix_seconds(c.cast("timestamp"))
        elif kind == "date":
            c = F.unix_seconds(c.cast("timestamp"))
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = F.round(c, 6)
        elif kind.startswith("array<"):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None, *views: str):
    """Register a function of ``Tables``; ``sql`` runs over the named fleet tables in DuckDB."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: flat(f(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = adapters.with_views(sql, *views)
        return f

    return add


def sec(c: str) -> str:
    return f"CAST(epoch({c}) AS BIGINT)"


def long(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


def nm(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2.0 * 3440.065 * asin(sqrt(least({a}, 1.0))))"


CATEGORY = """CASE WHEN ceiling_ft IS NULL AND visibility_sm IS NULL THEN NULL
  WHEN ceiling_ft < 500 OR visibility_sm < 1 THEN 'LIFR' WHEN ceiling_ft < 1000 OR visibility_sm < 3 THEN 'IFR'
  WHEN ceiling_ft < 3000 OR visibility_sm <= 5 THEN 'MVFR' ELSE 'VFR' END"""
OPEN = "status NOT IN ('resolved', 'closed')"
CURRENT = """current AS (SELECT * EXCLUDE (n) FROM (SELECT icao24, callsign, lat, lon, altitude_ft, speed_kt, heading_deg, vertical_rate_fpm, on_ground, customer_region,
  coalesce(ts_position, ts_polled) AS last_seen_at, row_number() OVER (PARTITION BY icao24 ORDER BY coalesce(ts_position, ts_polled) DESC, event_id) AS n FROM positions) WHERE n = 1)"""
NOW = "(SELECT max(last_seen_at) FROM current)"
CASE_NOW = "(SELECT max(created_at) FROM cases)"
