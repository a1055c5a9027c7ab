"""Typed readers of feed and reference files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..schemas import STATE_FIELDS


def decode_state_vectors(df: DataFrame, column: str = "value") -> DataFrame:
    """Rows of JSON ``{"time", "states": [[17 values]]}`` to typed state vectors.

    A vector shorter than 17 or with a blank id is dropped; empty callsign and squawk are null.
    """
    doc = F.from_json(column, "struct<time:bigint,states:array<array<string>>>")
    df = df.select(doc.alias("d")).select(F.col("d.time").alias("snapshot_time"), F.explode("d.states").alias("s"))
    df = df.filter((F.size("s") >= 17) & (F.coalesce(F.trim(F.get("s", F.lit(0))), F.lit("")) != ""))
    at = {name: F.get("s", F.lit(i)) for i, name in enumerate(STATE_FIELDS)}
    number = lambda c: c.try_cast("double")
    out: dict[str, Column] = {
        "icao24": F.lower(F.trim(at["icao24"])),
        "callsign": sc.opt_str(F.trim(at["callsign"])),
        "origin_country": at["origin_country"],
        "time_position": number(at["time_position"]).cast("long"),
        "last_contact": number(at["last_contact"]).cast("long"),
        **{c: number(at[c]) for c in ("lon", "lat", "altitude_m", "velocity_ms", "true_track_deg", "vertical_rate_ms", "geo_altitude_m")},
        "on_ground": F.coalesce(at["on_ground"].try_cast("boolean"), F.lit(False)),
        "squawk": sc.opt_str(at["squawk"]),
        "spi": F.coalesce(at["spi"].try_cast("boolean"), F.lit(False)),
        "position_source": F.coalesce(number(at["position_source"]).cast("int"), F.lit(0)),
    }
    return df.select("snapshot_time", *(c.alias(n) for n, c in out.items()))


def read_state_vectors(spark: SparkSession, path: str) -> DataFrame:
    return decode_state_vectors(spark.read.text(path, wholetext=True))


def read_flight_history(spark: SparkSession, path: str) -> DataFrame:
    """Flight history JSON; rows without id or either time are dropped."""
    schema = "icao24 string, firstSeen long, lastSeen long, callsign string, estDepartureAirport string, estArrivalAirport string, departureAirportCandidatesCount int, arrivalAirportCandidatesCount int"
    df = spark.read.schema(schema).json(path, multiLine=True).filter("icao24 is not null and firstSeen is not null and lastSeen is not null")
    trimmed = lambda c: sc.opt_str(F.trim(c))
    return df.select(
        F.lower(F.trim("icao24")).alias("icao24"),
        F.timestamp_seconds("firstSeen").alias("first_seen"),
        F.timestamp_seconds("lastSeen").alias("last_seen"),
        trimmed("callsign").alias("callsign"),
        trimmed("estDepartureAirport").alias("origin_icao"),
        trimmed("estArrivalAirport").alias("destination_icao"),
        F.coalesce("departureAirportCandidatesCount", F.lit(0)).alias("departure_candidates"),
        F.coalesce("arrivalAirportCandidatesCount", F.lit(0)).alias("arrival_candidates"),
    )


def read_metar(spark: SparkSession, path: str) -> DataFrame:
    """METAR JSON to typed observations; a variable wind direction is null (S3)."""
    schema = "icaoId string, rawOb string, obsTime long, wspd int, wdir string, visib string, temp double, altim double, clouds array<struct<cover:string,base:int>>"
    df = spark.read.schema(schema).json(path, multiLine=True).filter("icaoId is not null")
    return df.select(
        F.upper(F.trim("icaoId")).alias("site_icao"),
        F.col("rawOb").alias("metar_raw"),
        F.when(F.col("obsTime") > 0, F.timestamp_seconds("obsTime")).alias("observed_at"),
        F.col("wspd").alias("wind_kt"),
        F.col("wdir").try_cast("int").alias("wind_dir_deg"),
        sc.parse_visibility("visib").alias("visibility_sm"),
        F.col("temp").alias("temperature_c"),
        sc.altimeter_inhg("altim").alias("altimeter_in_hg"),
        F.col("clouds"),
    )


def read_taf(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("icaoId string, rawTAF string").json(path, multiLine=True)
    return df.select(F.upper(F.trim("icaoId")).alias("site_icao"), F.col("rawTAF").alias("taf_raw")).filter("coalesce(site_icao, '') <> '' and coalesce(trim(taf_raw), '') <> ''")


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Watchlist JSON object to ``icao, customer_regions``."""
    doc = F.from_json("value", "struct<airports:map<string,struct<customer_regions:array<string>>>>")
    return spark.read.text(path, wholetext=True).select(F.explode(doc["airports"]).alias("icao", "v")).select("icao", F.coalesce("v.customer_regions", F.array().cast("array<string>")).alias("customer_regions"))


def read_airports(spark: SparkSession, path: str, watchlist: DataFrame) -> DataFrame:
    """US airports with scheduled service, large or medium, with their watch regions."""
    df = spark.read.csv(path, header=True)
    df = df.filter("iso_country = 'US' and type in ('large_airport', 'medium_airport') and scheduled_service = 'yes'")
    text = lambda c: sc.opt_str(F.trim(c))
    df = df.select(
        F.upper(F.trim("ident")).alias("icao"),
        text("iata_code").alias("iata"),
        F.trim("name").alias("name"),
        text("municipality").alias("city"),
        sc.state_of("iso_region").alias("state"),
        F.col("iso_country").alias("country"),
        F.col("latitude_deg").try_cast("double").alias("lat"),
        F.col("longitude_deg").try_cast("double").alias("lon"),
        F.col("elevation_ft").try_cast("double").cast("int").alias("elevation_ft"),
    )
    # an airport that several documents list is watched once, for all of their regions
    regions = F.array_distinct(F.flatten(F.sort_array(F.collect_set("customer_regions"))))
    df = df.join(watchlist.groupBy("icao").agg(regions.alias("customer_regions")), "icao", "left")
    return df.withColumns({"is_watched": F.col("customer_regions").isNotNull(), "customer_regions": F.coalesce("customer_regions", F.array().cast("array<string>"))})


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Aircraft registry CSV; blank ids go, the first line of an id wins, by file, block and line."""
    df = spark.read.csv(path, header=True).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("_line"))
    text = lambda c: sc.opt_str(F.trim(c))
    df = df.withColumn("icao24", F.lower(F.trim("icao24"))).filter("coalesce(icao24, '') <> ''")
    df = df.select("icao24", text("registration").alias("registration"), text("typecode").alias("type_code"), text("model").alias("type_name"), text("operator").alias("operator"), text("operatoricao").alias("operator_icao"), "_line")
    return first_per_key(df, ["icao24"], ["_line"]).drop("_line")


def read_denylist(spark: SparkSession, path: str) -> DataFrame:
    """Prefixes, one a line, comments cut; anything but lower-case hex fails the query."""
    df = spark.read.text(path).select(F.trim(F.get(F.split("value", "#"), F.lit(0))).alias("prefix")).filter("prefix <> ''")
    bad = F.raise_error(F.concat(F.lit("not a lower-case hex prefix: "), F.col("prefix"))).cast("string")
    return df.select(F.when(F.col("prefix").rlike("^[0-9a-f]+$"), F.col("prefix")).otherwise(bad).alias("prefix"))
