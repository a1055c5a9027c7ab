"""Fixed schemas of the stored tables and of the rule contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

_TYPES = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def fields(text: str) -> StructType:
    """``name type [not null]`` entries as a schema; needs no session, unlike Spark's own parser."""
    entries = (e.split() for e in text.split(","))
    return StructType([StructField(e[0], _TYPES[e[1]], e[2:] != ["not", "null"]) for e in entries])


# Names, types and order of the stored columns.
POSITIONS = fields(
    "icao24 string not null, callsign string, origin_country string, lat double, lon double, altitude_ft int, speed_kt int, heading_deg int, "
    "vertical_rate_fpm int, on_ground boolean not null, squawk string, ts_polled timestamp not null, ts_position timestamp, customer_region string"
)
FLIGHTS_ARCHIVE = fields(
    "flight_id string not null, icao24 string not null, takeoff_ts timestamp not null, landed_at timestamp not null, callsign string, registration string, "
    "aircraft_type string, operator_icao string, customer_region string, origin_icao string, destination_icao string, eta_minutes int, status string, current_stage string, "
    "lat double, lon double, open_case_count int, open_case_ids string, status_timeline string, trail_2h string, archived_at timestamp not null"
)
ANOMALY = fields("rule string, icao24 string, site_icao string, customer_region string, detection_facts string, severity_hint string, dedup_key string")
ENRICHED = ("icao24", "callsign", "lat", "lon", "altitude_ft", "heading_deg", "vertical_rate_fpm", "on_ground", "ts_polled", "customer_region", "origin_icao", "destination_icao", "departure_time", "nearest_site_icao", "nearest_site_distance_nm")

# Positions of the state vector.
STATE_FIELDS = ("icao24", "callsign", "origin_country", "time_position", "last_contact", "lon", "lat", "altitude_m", "on_ground", "velocity_ms", "true_track_deg", "vertical_rate_ms", "sensors", "geo_altitude_m", "squawk", "spi", "position_source")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` cast to ``schema``, columns in its order; a missing column is null."""
    from pyspark.sql import functions as F

    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``df``, or an error that names the columns of the contract that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
