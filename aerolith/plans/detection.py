"""One detection cycle over the lake or any positions frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import joins, kpi, rules
from ..sources.upserts import case_rows


#: Minutes of positions that one cycle looks at.
LOOKBACK_MINUTES = 30


def window(positions: DataFrame, minutes: int = LOOKBACK_MINUTES, now: Column | None = None) -> DataFrame:
    """Positions of the last ``minutes`` up to ``now``, or up to the newest poll, which one row tells."""
    if now is None:
        positions = positions.crossJoin(F.broadcast(positions.agg(F.max("ts_polled").alias("_until"))))
        now = F.col("_until")
    out = positions.filter((F.col("ts_polled") >= now - F.expr(f"interval {int(minutes)} minutes")) & (F.col("ts_polled") <= now))
    return out.drop("_until")


def context(positions: DataFrame, plans: DataFrame, airports: DataFrame, conditions: DataFrame, cells: DataFrame, options: dict[str, dict] | None = None) -> rules.Context:
    sites = airports.filter("is_watched")
    weather = conditions if "flight_category" in conditions.columns else conditions.withColumn("flight_category", sc.flight_category("ceiling_ft", "visibility_sm"))
    return rules.enriched_context(positions, plans, sites, weather, cells, airports, options)


def new_cases(ctx: rules.Context, cases: DataFrame, runbooks: DataFrame, now: Column, start: int, year: int) -> tuple[DataFrame, DataFrame]:
    """Case rows with ids and runbooks, and detections by rule."""
    found = rules.detect(ctx, cases, now)
    rows = joins.with_runbooks(case_rows(found), runbooks)
    return sc.case_ids(rows, start, year, "case_type", "flight_id", "site_icao", "detection_facts"), kpi.by_rule(found)
