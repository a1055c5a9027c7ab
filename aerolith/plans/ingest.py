"""From decoded state vectors to stored positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import joins


def to_positions(states: DataFrame, prefixes: DataFrame, sites: DataFrame) -> DataFrame:
    """State vectors to positions: denylist, coordinates, units, times, region."""
    df = sc.to_storage_units(sc.drop_no_coords(joins.apply_denylist(states, prefixes)))
    df = df.withColumns({"ts_polled": F.timestamp_seconds("snapshot_time"), "ts_position": sc.epoch_time("time_position")})
    return joins.infer_region(df, sites).select("icao24", "callsign", "origin_country", "lat", "lon", "altitude_ft", "speed_kt", "heading_deg", "vertical_rate_fpm", "on_ground", "squawk", "ts_polled", "ts_position", "customer_region")


def to_current(positions: DataFrame) -> DataFrame:
    """Positions as rows of the last-known state."""
    return positions.withColumn("last_seen_at", sc.event_time("ts_position", "ts_polled")).drop("ts_position", "ts_polled")
