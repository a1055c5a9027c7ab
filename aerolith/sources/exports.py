"""Exports as frames of JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import scalars as sc


def camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m[1].upper(), name)


def _value(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if kind.startswith(("array<struct", "struct", "map")):
        return F.to_json(name)
    return F.col(name)


def export_objects(df: DataFrame, kind: str) -> DataFrame:
    """One ``value`` a row: camel-case keys, no nulls, nested values as JSON text, UTC times."""
    shapes = {"aircraft": "position", "site": "location", "flight": "position"}
    key = {"aircraft": "icao24", "site": "icao", "flight": "flight_id", "case": "case_id"}[kind]
    extra = [F.to_json(geo.point("lat", "lon")).alias(shapes[kind])] if kind in shapes and {"lat", "lon"} <= set(df.columns) else []
    if kind == "flight" and "trail_2h" in df.columns:
        extra.append(F.to_json(geo.line("trail_2h")).alias("trailPath"))
    fields = [F.col(key).alias(kind), *(_value(df, c).alias(camel(c)) for c in df.columns), *extra]
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def trails_ndjson(trails: DataFrame) -> DataFrame:
    """One JSON object an aircraft, by id."""
    return trails.sortWithinPartitions("icao24").select("icao24", F.to_json(F.struct("icao24", "n_points", "points")).alias("value"))


def trail_texts(pieces: DataFrame) -> DataFrame:
    """``icao24, piece, text``: the texts of an aircraft's pieces, one after another, are its line of JSON."""
    head = F.to_json(F.struct("icao24", "n_points"))
    points = F.array_join(F.transform("points", lambda p: F.to_json(p)), ",")
    start = F.when(F.col("piece") == 0, F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"points":['))).otherwise(",")
    end = F.when(F.col("piece") == F.col("n_pieces") - 1, "]}\n").otherwise("")
    return pieces.withColumn("head", head).select("icao24", "piece", F.concat(start, points, end).alias("text"))


def write_trails(pieces: DataFrame, path: str) -> None:
    """Trails of any length as text files, which in the order of their names are one text of JSON lines.

    Files hold ranges of aircraft and piece, so a long line runs on in the next file and no task holds it whole.
    Where one piece ends and the next begins the text has a blank, which JSON passes over.
    """
    by = ("icao24", "piece")
    trail_texts(pieces).repartitionByRange(*by).sortWithinPartitions(*by).select("text").write.option("lineSep", " ").text(path)


def export_crm_cases(cases: DataFrame, n: int) -> DataFrame:
    """The oldest ``n`` pending cases as CRM change sets, nulls left out."""
    some = cases.filter("sf_sync_status = 'pending'").orderBy("created_at", "case_id").limit(n)
    fields = {
        "externalId": F.col("case_id"),
        "subject": sc.case_subject("case_type", "site_icao", "detection_facts"),
        "priority": sc.to_priority("severity"),
        "region": sc.region_title("customer_region"),
        "caseType": F.col("case_type"),
        "flightId": F.col("flight_id"),
        "siteIcao": sc.opt_str("site_icao"),
        "facts": F.col("detection_facts"),
    }
    if "runbook_refs" in cases.columns:
        fields["runbookRefs"] = sc.opt_str(sc.join_refs("runbook_refs"))
    return some.select("case_id", F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("value"))
