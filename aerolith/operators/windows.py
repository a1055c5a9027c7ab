"""Ordered operators per aircraft (W1 to W9) and trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..shared import cut


def latest_per_key(df: DataFrame, keys: list[str], ts: str, *ties: str) -> DataFrame:
    """The newest row of each key; ties go to the smallest of the ``ties`` columns."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), *ties)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_flight(flights: DataFrame) -> DataFrame:
    """``icao24, flight_id, takeoff`` of each aircraft's newest key; malformed keys are skipped."""
    parsed = flights.select("flight_id", sc.parse_flight_key("flight_id").alias("k")).filter("k is not null")
    return parsed.groupBy(F.col("k.icao24").alias("icao24")).agg(F.max(F.struct("k.takeoff", "flight_id")).alias("b")).select("icao24", "b.flight_id", "b.takeoff")


def lifecycle_edges(positions: DataFrame, max_gap_s: int | None = None, *ties: str) -> DataFrame:
    """Takeoffs and landings: ``icao24, kind, at, flight_id``.

    The first fix only seeds; a landing needs the takeoff it ends, whose key it carries.  With
    ``max_gap_s`` an absence longer than that forgets the aircraft: the next fix seeds again.
    """
    w = Window.partitionBy("icao24").orderBy("ts_polled", *ties)
    df = positions.select("icao24", "ts_polled", "on_ground", *ties).withColumn("_was", F.lag("on_ground").over(w)).withColumn("_gap", sc.epoch("ts_polled") - sc.epoch(F.lag("ts_polled").over(w)))
    fresh = F.col("_was").isNull() if max_gap_s is None else F.col("_was").isNull() | (F.col("_gap") > max_gap_s)
    df = df.withColumn("_run", F.sum(fresh.cast("int")).over(w)).withColumn("_was", F.when(~fresh, F.col("_was")))
    kind = F.when(F.col("_was") & ~F.col("on_ground"), "takeoff").when(~F.col("_was") & F.col("on_ground"), "landing")
    edges = df.withColumn("kind", kind).filter("kind is not null")
    # edges alternate inside a run, so a landing's takeoff is the edge before it
    e = Window.partitionBy("icao24", "_run").orderBy("ts_polled", *ties)
    key = sc.flight_key("icao24", "ts_polled")
    edges = edges.withColumn("_open", F.lag(F.when(F.col("kind") == "takeoff", key)).over(e))
    edges = edges.withColumn("flight_id", F.when(F.col("kind") == "takeoff", key).otherwise(F.col("_open"))).filter("flight_id is not null")
    return edges.select("icao24", "kind", F.col("ts_polled").alias("at"), "flight_id")


def new_flights(edges: DataFrame) -> DataFrame:
    """Flight records of takeoffs, seeded with one timeline event."""
    none = lambda kind: F.lit(None).cast(kind)
    texts = ("callsign", "registration", "aircraft_type", "operator_icao", "customer_region", "origin_icao", "destination_icao")
    return edges.filter("kind = 'takeoff'").select(
        "flight_id",
        "icao24",
        F.col("at").alias("takeoff_ts"),
        none("timestamp").alias("landed_at"),
        *(none("string").alias(c) for c in texts),
        none("int").alias("eta_minutes"),
        F.lit("departed").alias("status"),
        F.lit("departed").alias("current_stage"),
        F.lit(True).alias("is_live"),
        F.lit(0).alias("open_case_count"),
        F.array().cast("array<string>").alias("open_case_ids"),
        F.array(F.struct(F.lit("departed").alias("stage"), F.col("at").alias("occurred_at"))).alias("status_timeline"),
        F.array().cast("array<struct<ts:timestamp,lat:double,lon:double,altitude_ft:int,speed_kt:int>>").alias("trail_2h"),
    )


def latest_leg(history: DataFrame, begin: Column | None = None, end: Column | None = None) -> DataFrame:
    """The most recent leg of each aircraft that was seen in the fetch window [begin, end].

    Of legs seen last at one time the later start wins, then the larger texts, so ties have one result.
    """
    if begin is not None:
        history = history.filter((F.col("last_seen") >= begin) & (F.col("first_seen") <= end))
    leg = F.struct("first_seen", "last_seen", "callsign", "origin_icao", "destination_icao")
    order = F.struct("last_seen", "first_seen", *(F.coalesce(c, F.lit("")) for c in ("callsign", "origin_icao", "destination_icao")))
    return history.groupBy("icao24").agg(F.max_by(leg, order).alias("b")).select("icao24", "b.*")


def trails(positions: DataFrame) -> DataFrame:
    """``icao24, n_points, points``: the fixes of each aircraft in time order."""
    point = F.struct(F.col("ts_polled").alias("ts"), "lat", "lon", "altitude_ft", "speed_kt")
    return positions.groupBy("icao24").agg(F.array_sort(F.collect_list(point)).alias("points")).select("icao24", F.size("points").alias("n_points"), "points")


def numbered(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``df`` with ``n``, the place of each row among those of its key by ``order`` (from 1), and ``n_of_key``.

    Rows are dealt by ranges of key and order, so one key may fill many tasks; places inside a range follow from the
    sorted rows, and what earlier ranges hold of a key is added from one count a key and range.  The ranges are
    materialised: a lost task could not draw the same ones again.
    """
    by = (*keys, *order)
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows).withColumn("_range", F.shiftright("_at", 33))
    held = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*keys, "_range", "_first", before.alias("_before"), F.sum("_n").over(w).alias("n_of_key"))
    return rows.join(held, [*keys, "_range"]).withColumn("n", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_range", "_first", "_before")


def trail_pieces(positions: DataFrame, size: int = 5_000, *ties: str) -> DataFrame:
    """``icao24, n_points, n_pieces, piece, points``: trails of any length, at most ``size`` fixes a row.

    ``n_points`` and ``n_pieces`` are of the whole trail; pieces are numbered from 0 in time order.  Rows without an id have no trail.
    """
    by = ("ts_polled", *(ties or ("lat", "lon", "altitude_ft", "speed_kt")))
    fields = dict.fromkeys(["icao24", "ts_polled", "lat", "lon", "altitude_ft", "speed_kt", *ties])
    df = numbered(positions.filter("icao24 is not null").select(*fields), ["icao24"], *by)
    point = F.struct(F.col("ts_polled").alias("ts"), "lat", "lon", "altitude_ft", "speed_kt")
    piece = F.floor((F.col("n") - 1) / size).alias("piece")
    df = df.groupBy("icao24", "n_of_key", piece).agg(F.array_sort(F.collect_list(F.struct("n", point.alias("p")))).alias("points"))
    return df.select("icao24", F.col("n_of_key").alias("n_points"), F.ceil(F.col("n_of_key") / size).alias("n_pieces"), "piece", F.transform("points", lambda x: x["p"]).alias("points"))


def trail(positions: DataFrame, icao24: str, hours: int, now: Column) -> DataFrame:
    """One aircraft's fixes of the last 1, 2, 4 or 6 hours."""
    if hours not in (1, 2, 4, 6):
        raise ValueError("a trail looks back 1, 2, 4 or 6 hours")
    df = positions.filter((F.col("icao24") == icao24) & (F.col("ts_polled") >= now - F.expr(f"interval {hours} hours")) & (F.col("ts_polled") <= now))
    return df.select(F.col("ts_polled").alias("ts"), "lat", "lon", "altitude_ft", "speed_kt").orderBy("ts")


def material_changes(matched: DataFrame) -> DataFrame:
    """Timeline events of rows with old_ and new_ status, severity and resolved_at."""
    event = lambda name, old, new: F.struct(F.lit(name).alias("event_type"), F.col(old).cast("string").alias("old"), F.col(new).cast("string").alias("new"))
    changes = F.array(
        F.when(~F.col("new_status").eqNullSafe(F.col("old_status")), event("status_changed", "old_status", "new_status")),
        F.when(F.col("new_severity").isNotNull() & ~F.col("new_severity").eqNullSafe(F.col("old_severity")), event("severity_changed", "old_severity", "new_severity")),
        F.when(F.col("new_resolved_at").isNotNull() & F.col("old_resolved_at").isNull(), event("resolved", "old_resolved_at", "new_resolved_at")),
    )
    return matched.select("case_id", F.explode(F.array_compact(changes)).alias("e")).select("case_id", "e.*")
