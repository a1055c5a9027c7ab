"""Scalar rules as column expressions (P1 to P50 without the geographic ones)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import col

# Unit factors, category names from best to worst, status and stage tables.
M_TO_FT, MS_TO_KT, MS_TO_FPM, HPA_TO_INHG = 3.28084, 1.94384, 196.850, 0.02953
CATEGORIES = ("VFR", "MVFR", "IFR", "LIFR")
CEILING_COVERS = ("BKN", "OVC", "OVX", "VV")
SEVERITIES = ("low", "medium", "high")
STAGE_STATUS = {"departed": "departed", "climb": "enroute", "cruise": "enroute", "descent": "enroute", "approach": "approaching", "landed": "landed"}
PRIORITY = {"low": "Low", "medium": "Medium", "high": "High", "critical": "High"}
FROM_PRIORITY = {"Low": "low", "Medium": "medium", "High": "high"}
CRM_STATUS = {"New": "open", "Acknowledged": "acknowledged", "Working": "in_progress", "In Progress": "in_progress", "Escalated": "escalated", "Resolved": "resolved", "Closed": "closed"}
REGIONS = {"west": "West", "east": "East", "all": "All"}
OPEN_STATUSES = ("open", "acknowledged", "in_progress")


def lookup(key, table: dict[str, str], default: Column | None = None) -> Column:
    """Value of ``key`` in a small fixed table, or ``default``."""
    found = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[col(key)]
    return found if default is None else F.coalesce(found, default)


def epoch(ts) -> Column:
    return F.unix_seconds(col(ts).cast("timestamp"))


def minutes_between(later, earlier) -> Column:
    return (epoch(later) - epoch(earlier)) / 60.0


# -- ingest -------------------------------------------------------------------


def to_int(x, factor: float = 1.0) -> Column:
    """``x * factor`` as int, half to even; null stays null."""
    return F.bround(col(x) * F.lit(factor), 0).cast("int")


def to_storage_units(df: DataFrame) -> DataFrame:
    """Metric state vectors to feet, knots, feet a minute and whole degrees."""
    return df.withColumns(
        {
            "altitude_ft": to_int("altitude_m", M_TO_FT),
            "speed_kt": to_int("velocity_ms", MS_TO_KT),
            "heading_deg": to_int("true_track_deg"),
            "vertical_rate_fpm": to_int("vertical_rate_ms", MS_TO_FPM),
        }
    )


def drop_no_coords(df: DataFrame) -> DataFrame:
    return df.filter("lat is not null and lon is not null")


def collapse_region(regions) -> Column:
    """No region: null; one: itself; several: 'all' (P4)."""
    regions = col(regions)
    return F.when(F.size(regions) == 1, F.get(regions, F.lit(0))).when(F.size(regions) > 1, F.lit("all"))


def epoch_time(x) -> Column:
    """Epoch seconds to a timestamp; 0 is no time."""
    return F.timestamp_seconds(F.nullif(col(x).cast("double"), F.lit(0.0)))


def event_time(position, polled) -> Column:
    return F.coalesce(col(position), col(polled))


def opt_str(x) -> Column:
    return F.nullif(col(x), F.lit(""))


def opt_float(x) -> Column:
    x = col(x).cast("double")
    return F.when(~F.isnan(x), x)


def region_of(x) -> Column:
    return F.coalesce(opt_str(x), F.lit("all"))


def lag_seconds(df: DataFrame, polled: str, source: str) -> DataFrame:
    """One row: seconds from the newest source time to the newest poll, at least 0; -1 for no rows."""
    gap = epoch(F.max(polled)) - epoch(F.max(source))
    return df.agg(F.coalesce(F.when(gap < 0, F.lit(0)).otherwise(gap), F.lit(-1)).cast("long").alias("lag_seconds"))


def to_utc(text) -> Column:
    """ISO text with Z, +0000 or any offset to an instant; blank or malformed is null (P50)."""
    return F.try_to_timestamp(opt_str(F.trim(col(text))))


# -- weather ------------------------------------------------------------------


def ceiling_ft(clouds) -> Column:
    """Lowest base among the covers that make a ceiling."""
    layers = F.filter(col(clouds), lambda c: c["cover"].isin(*CEILING_COVERS) & c["base"].isNotNull())
    return F.array_min(F.transform(layers, lambda c: c["base"])).cast("int")


def flight_category(ceiling, visibility) -> Column:
    """The worse of the categories by ceiling and by visibility; a missing one is unlimited, both missing is null."""
    ceiling, visibility = col(ceiling), col(visibility)
    by_ceiling = F.when(ceiling < 500, 3).when(ceiling < 1000, 2).when(ceiling < 3000, 1).otherwise(0)
    by_sight = F.when(visibility < 1, 3).when(visibility < 3, 2).when(visibility <= 5, 1).otherwise(0)
    return F.when(ceiling.isNotNull() | visibility.isNotNull(), F.get(F.array(*map(F.lit, CATEGORIES)), F.greatest(by_ceiling, by_sight)))


def parse_visibility(text) -> Column:
    """A number or 'N+' as statute miles, other text null (P10)."""
    return F.regexp_replace(F.trim(col(text).cast("string")), r"\+$", "").try_cast("double")


def altimeter_inhg(hpa) -> Column:
    return F.bround(col(hpa).cast("double") * HPA_TO_INHG, 2)


def weather_impact(category) -> Column:
    return F.when(col(category) == "LIFR", "high").when(col(category) == "IFR", "medium").otherwise("low")


# -- rules --------------------------------------------------------------------


def is_ga(callsign) -> Column:
    """General-aviation callsign: N and a digit; null is not one."""
    return F.coalesce(col(callsign).rlike("^N[0-9]"), F.lit(False))


def lost_signal_severity(altitude_ft, gap_minutes, sparse) -> Column:
    """Tier by altitude, one down in a sparse cell, one up from 20 minutes on; clamped after each step."""
    altitude_ft, gap_minutes = col(altitude_ft), col(gap_minutes)
    base = F.when(altitude_ft < 30_000, 2).when(altitude_ft < 35_000, 1).otherwise(0)
    lower = F.greatest(base - F.coalesce(col(sparse), F.lit(False)).cast("int"), F.lit(0))
    return F.get(F.array(*map(F.lit, SEVERITIES)), F.least(lower + (gap_minutes >= 20).cast("int"), F.lit(2)))


def staleness(ts, now) -> Column:
    age = epoch(now) - epoch(ts)
    return F.when(age < 60, "fresh").when(age < 300, "stale").otherwise("lost")


# -- cases --------------------------------------------------------------------


def case_subject(case_type, site, facts) -> Column:
    """Title of a case from its type, site and facts (JSON), with fallbacks."""
    case_type, facts = col(case_type), col(facts)
    fact = lambda key, default: F.coalesce(opt_str(F.get_json_object(facts, f"$.{key}")), F.lit(default))
    callsign, site = fact("callsign", "unknown"), F.coalesce(opt_str(site), F.lit("unknown site"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    # The titles' wording.
    return (
        F.when(case_type == "lost_signal", say("Lost signal during cruise — ", callsign, " near ", site))
        .when(case_type == "diversion", say("Diversion — ", callsign, " ", fact("origin", "?"), "→", fact("alternate", "?"), " (was ", fact("expected_destination", "?"), ")"))
        .when(case_type == "excessive_hold", say("Excessive holding pattern — ", callsign, " near ", site))
        .when(case_type == "weather_impact", say("Weather impact — ", site, " (", fact("flight_category", "unknown"), ")"))
        .when(case_type == "go_around", say("Go-around — ", callsign, " at ", site))
        .when(case_type == "delay", say("Delayed flight — ", callsign, " ", fact("origin", "?"), "→", fact("destination", "?")))
        .otherwise(say(case_type, " — ", callsign, " near ", site))
    )


def to_priority(severity) -> Column:
    return lookup(severity, PRIORITY, F.lit("Medium"))


def from_priority(priority) -> Column:
    """Back from the CRM's priority; critical is lost on the way."""
    return lookup(priority, FROM_PRIORITY)


def from_crm_status(status) -> Column:
    return lookup(status, CRM_STATUS, F.lit("open"))


def region_title(code) -> Column:
    """Title case of a region code; an unknown code fails the query (P25)."""
    found = lookup(code, REGIONS)
    return F.when(col(code).isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown region: "), col(code))).cast("string"))


def region_code(title) -> Column:
    found = lookup(title, {v: k for k, v in REGIONS.items()})
    return F.when(col(title).isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown region: "), col(title))).cast("string"))


def split_refs(text) -> Column:
    """Comma list to trimmed entries without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def join_refs(refs) -> Column:
    return F.array_join(col(refs), ", ")


def resolution_hours(created, closed) -> Column:
    return (epoch(closed) - epoch(created)) / 3600.0


def case_url(base, case_ref) -> Column:
    return F.concat(F.regexp_replace(col(base), "/+$", ""), F.lit("/lightning/r/Case/"), col(case_ref), F.lit("/view"))


def case_ids(df: DataFrame, start: int, year: int, *order: str) -> DataFrame:
    """``df`` with ``case_id`` CASE-year-number, numbered from ``start`` in a fixed order.

    Numbers are a row's place among the new cases: ranges are sorted by ``order`` and counted, so
    no task holds all rows.  The sorted ranges are materialised, since ranges come from a sample
    and could differ where the plan is run twice.
    """
    from pyspark.sql import Window

    from ..shared import cut

    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_row"))
    numbered = ordered.withColumn("_inside", inside).join(F.broadcast(before.select("_part", "_before")), "_part")
    number = F.lpad((F.col("_before") + F.col("_inside") + F.lit(start - 1)).cast("string"), 6, "0")
    return numbered.withColumn("case_id", F.concat(F.lit(f"CASE-{year}-"), number)).drop("_part", "_row", "_inside", "_before")


def case_violations(cases: DataFrame) -> DataFrame:
    """Rows that break a quality rule, one row a rule."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    no_text = cases.filter(F.col("status").isin("resolved", "closed") & blank("summary")).select("case_id", F.lit("resolve_requires_description").alias("violation"))
    short = cases.filter((F.col("status") == "escalated") & (F.length(F.coalesce(F.trim("severity_justification"), F.lit(""))) < 10))
    return no_text.unionByName(short.select("case_id", F.lit("escalate_requires_justification").alias("violation")))


def manual_steps(text) -> Column:
    """Non-blank lines without the automatic ones."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("[Auto]"))


def scalar_facts(facts) -> Column:
    """JSON object's scalar members as a map of text; nulls, objects and arrays go."""
    members = F.from_json(col(facts), "map<string,variant>")
    plain = F.map_filter(members, lambda k, v: ~F.is_variant_null(v) & ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"))
    return F.transform_values(plain, lambda k, v: F.variant_get(v, "$", "string"))


# -- flights ------------------------------------------------------------------


def flight_key(icao24, takeoff) -> Column:
    return F.concat_ws("-", col(icao24), epoch(takeoff).cast("string"))


def parse_flight_key(key) -> Column:
    """struct(icao24, takeoff) split at the last dash; null if malformed."""
    key = col(key)
    second = F.regexp_extract(key, r"^.+-(\d{1,18})$", 1).try_cast("long")
    return F.when(key.rlike(r"^.+-\d{1,18}$"), F.struct(F.regexp_extract(key, r"^(.+)-\d+$", 1).alias("icao24"), F.timestamp_seconds(second).alias("takeoff")))


def current_stage(timeline) -> Column:
    return F.try_element_at(col(timeline), F.lit(-1))["stage"]


def flight_status(timeline) -> Column:
    return lookup(current_stage(timeline), STAGE_STATUS, F.lit("unknown"))


def landed_at(timeline) -> Column:
    return F.get(F.filter(col(timeline), lambda x: x["stage"] == "landed"), F.lit(0))["occurred_at"]


def normalise_ids(ids) -> Column:
    """Trimmed lower-case six-digit hex ids, first occurrence each."""
    return F.array_distinct(F.filter(F.transform(col(ids), lambda x: F.lower(F.trim(x))), lambda x: x.rlike("^[0-9a-f]{6}$")))


def state_of(iso_region) -> Column:
    return opt_str(F.regexp_extract(col(iso_region), "^US-(.+)$", 1))


# -- scopes -------------------------------------------------------------------


def seen_within(df: DataFrame, minutes: int, now, ts: str = "last_seen_at") -> DataFrame:
    return df.filter(F.col(ts) >= col(now) - F.expr(f"interval {int(minutes)} minutes"))


def scope_positions(df: DataFrame, scope: str, region: str | None = None) -> DataFrame:
    """Rows of the caller's region and rows without one; asking for more than the scope raises."""
    if region and region != scope and scope != "all":
        raise PermissionError(f"scope {scope!r} cannot request region {region!r}")
    wanted = region or scope
    return df if wanted == "all" else df.filter((F.col("customer_region") == wanted) | F.col("customer_region").isNull())


def scope_cases(df: DataFrame, scope: str) -> DataFrame:
    return df if scope == "all" else df.filter(F.col("customer_region").isin(scope, "all"))


def scope_flights(df: DataFrame, scope: str) -> DataFrame:
    """Only another single region is hidden; null and 'all' are visible."""
    others = [r for r in ("west", "east") if r != scope]
    return df if scope == "all" else df.filter(F.col("customer_region").isNull() | ~F.col("customer_region").isin(*others))


def site_in_scope(regions, scope: str) -> Column:
    return F.lit(True) if scope == "all" else F.arrays_overlap(col(regions), F.array(F.lit(scope), F.lit("all")))


def filter_cases(df: DataFrame, statuses=OPEN_STATUSES, severity: str | None = None, site: str | None = None) -> DataFrame:
    df = df.filter(F.col("status").isin(*statuses))
    df = df if severity is None else df.filter(F.col("severity") == severity)
    return df if site is None else df.filter(F.col("site_icao") == site.upper())


def triage_eligible(df: DataFrame) -> DataFrame:
    return df.filter((F.col("record_type") == "fleet") & (F.coalesce(F.trim("case_type"), F.lit("")) != "") & F.col("severity_justification").isNull())


def in_live_scope(df: DataFrame, regions: list[str] | None = None) -> DataFrame:
    return df if regions is None else df.filter(F.col("customer_region").isin(*regions))


def case_view(df: DataFrame, name: str, now, owner: str | None = None) -> DataFrame:
    """A saved view of cases."""
    views = {
        "all_open": F.col("status").isin(*OPEN_STATUSES, "escalated"),
        "critical_open": (F.col("severity") == "critical") & ~F.col("status").isin("resolved", "closed"),
        "escalated": F.col("status") == "escalated",
        "recently_closed": F.col("status").isin("resolved", "closed") & (F.col("resolved_at") >= col(now) - F.expr("interval 7 days")),
        "mine_open": (F.col("owner") == F.lit(owner)) & ~F.col("status").isin("resolved", "closed") if owner else F.lit(False),
    }
    if name.startswith("rule:"):
        return df.filter((F.col("case_type") == name[5:]) & ~F.col("status").isin("resolved", "closed"))
    return df.filter(views[name])
