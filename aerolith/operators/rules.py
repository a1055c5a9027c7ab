"""The six anomaly rules, suppression and the detection pipeline.

A rule is one DataFrame expression over the enriched frame (schemas.ENRICHED and
feed_last_ts).  Thresholds are parameters whose defaults are the production values.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..schemas import ENRICHED, require
from ..shared import cut
from . import joins


@dataclass
class Context:
    """What rules read: enriched positions, site weather, sparse cells, airports.

    ``latest`` (newest row of each aircraft), ``near`` (rows with their nearest site, for rules over
    all fixes) and ``now`` (one row with the newest poll) are cheaper forms of the same rows; where
    they are not given they are taken from ``positions``.  ``written`` tells that ``near`` is materialised.
    """

    positions: DataFrame
    conditions: DataFrame
    cells: DataFrame
    airports: DataFrame
    options: dict[str, dict] = field(default_factory=dict)
    latest: DataFrame | None = None
    near: DataFrame | None = None
    now: DataFrame | None = None
    written: bool = False


class Rule:
    """A rule: name, suppression window in minutes, detection, identity of a finding."""

    case_type: str
    window_minutes: int

    def detect(self, ctx: Context) -> DataFrame:
        raise NotImplementedError

    def key(self, site: Column, icao24: Column, facts: Column) -> list[Column]:
        """Identity columns, from what anomalies and stored cases both carry."""
        return [icao24, F.coalesce(site, F.lit(""))]

    def found(self, df: DataFrame, icao24, site, region, severity, **facts: Column) -> DataFrame:
        text = F.to_json(F.struct(*(c.alias(k) for k, c in facts.items())))
        out = df.select(F.lit(self.case_type).alias("rule"), icao24.alias("icao24"), site.alias("site_icao"), region.alias("customer_region"), text.alias("detection_facts"), severity.alias("severity_hint"))
        return out.withColumn("dedup_key", self.dedup_key("site_icao", "icao24", "detection_facts"))

    def dedup_key(self, site: str, icao24: str, facts: str) -> Column:
        parts = self.key(F.col(site), F.col(icao24), F.col(facts))
        return F.concat_ws("|", F.lit(self.case_type), *(F.coalesce(p, F.lit("")) for p in parts))


def fact(facts: Column, name: str) -> Column:
    return F.get_json_object(facts, f"$.{name}")


def _latest(ctx: Context) -> DataFrame:
    return ctx.latest if ctx.latest is not None else newest_rows(require(ctx.positions, ENRICHED))


def newest_rows(df: DataFrame, feed: bool = False) -> DataFrame:
    """Newest in-scope fix of each aircraft, one pass with map-side combine.

    With ``feed``, ``df`` holds out-of-scope rows too, and ``feed_last_ts`` is the newest fix of both (J15).
    """
    values = [c for c in df.columns if c not in ("icao24", "feed_last_ts" if feed else "")]
    ties = F.struct("ts_polled", *(["event_id"] if "event_id" in values else []))
    scoped = F.col("customer_region").isNotNull() if feed else F.lit(True)
    last = [F.max("ts_polled").alias("feed_last_ts")] if feed else []
    out = df.groupBy("icao24").agg(F.max_by(F.struct(*values), F.when(scoped, ties)).alias("_r"), *last).filter("_r is not null")
    return out.select("icao24", *(F.col(f"_r.{c}").alias(c) for c in values), *(["feed_last_ts"] if feed else []))


def _now(df: DataFrame, ctx: Context) -> DataFrame:
    """``df`` with ``_now``, the newest poll of all in-scope rows; one row crosses, not a window over all."""
    now = ctx.now if ctx.now is not None else df.agg(F.max("ts_polled").alias("_now"))
    return df.crossJoin(F.broadcast(now))


#: What rules over all fixes read.
NEAR = ("icao24", "event_id", "ts_polled", "callsign", "customer_region", "on_ground", "altitude_ft", "heading_deg", "nearest_site_icao", "nearest_site_distance_nm")


def _near(ctx: Context, radius_nm: float) -> DataFrame:
    """Airborne fixes within ``radius_nm`` of a site."""
    df = ctx.near if ctx.near is not None else ctx.positions
    df = df.select(*(c for c in NEAR if c in df.columns))
    return df.filter((F.col("nearest_site_distance_nm") <= radius_nm) & ~F.col("on_ground"))


class LostSignal(Rule):
    case_type, window_minutes = "lost_signal", 360

    def detect(self, ctx: Context, floor_ft: int = 25_000, min_gap: float = 14, max_gap: float = 30, level_fpm: int = 500) -> DataFrame:
        df = _now(_latest(ctx), ctx)
        last = F.coalesce("feed_last_ts", "ts_polled") if "feed_last_ts" in df.columns else F.col("ts_polled")
        df = df.withColumn("_gap", sc.minutes_between("_now", last))
        level = F.col("vertical_rate_fpm").isNull() | (F.abs("vertical_rate_fpm") <= level_fpm)
        df = df.filter(~F.col("on_ground") & (F.col("altitude_ft") >= floor_ft) & F.col("_gap").between(min_gap, max_gap) & level)
        df = joins.with_sparse(df, ctx.cells).withColumn("_severity", sc.lost_signal_severity("altitude_ft", "_gap", "sparse")).filter("_severity <> 'low'")
        return self.found(
            df, F.col("icao24"), sc.opt_str("nearest_site_icao"), sc.region_of("customer_region"), F.col("_severity"),
            callsign=sc.opt_str("callsign"), last_lat=F.col("lat"), last_lon=F.col("lon"), last_altitude_ft=F.col("altitude_ft"),
            last_seen=F.date_format("ts_polled", "yyyy-MM-dd'T'HH:mm:ss'Z'"), gap_minutes=F.bround("_gap", 1),
        )


class Diversion(Rule):
    case_type, window_minutes = "diversion", 1440

    def detect(self, ctx: Context, radius_nm: float = 5.0) -> DataFrame:
        expected, landed = sc.opt_str("destination_icao"), sc.opt_str("nearest_site_icao")
        df = _latest(ctx).filter(F.col("on_ground") & expected.isNotNull() & (F.col("nearest_site_distance_nm") <= radius_nm) & (landed != expected))
        return self.found(df, F.col("icao24"), landed, sc.region_of("customer_region"), F.lit("high"), callsign=sc.opt_str("callsign"), origin=sc.opt_str("origin_icao"), expected_destination=expected, alternate=landed)

    def key(self, site, icao24, facts):
        return [icao24, fact(facts, "expected_destination"), fact(facts, "alternate")]


def _near_summary(near: DataFrame) -> list[Column]:
    """Site (the most frequent, lowest on a tie) and newest row of an aircraft's fixes near a site."""
    return [F.mode("nearest_site_icao", True).alias("site"), F.max_by(F.struct("callsign", "customer_region"), F.struct("ts_polled", *(["event_id"] if "event_id" in near.columns else []))).alias("last")]


class ExcessiveHold(Rule):
    case_type, window_minutes, radius_nm = "excessive_hold", 30, 15

    def detect(self, ctx: Context, radius_nm: float = radius_nm, ceiling: int = 15_000, min_minutes: float = 30, min_fixes: int = 10, min_sectors: int = 6) -> DataFrame:
        from ..functions.geo import heading_sector

        near = _near(ctx, radius_nm).filter(F.col("altitude_ft") <= ceiling)
        span = sc.minutes_between(F.max("ts_polled"), F.min("ts_polled")).alias("minutes")
        df = near.groupBy("icao24").agg(F.count("*").alias("n"), span, F.countDistinct(heading_sector("heading_deg")).alias("sectors"), *_near_summary(near))
        df = df.filter((F.col("n") >= min_fixes) & (F.col("minutes") >= min_minutes) & (F.col("sectors") >= min_sectors) & ~sc.is_ga("last.callsign"))
        return self.found(df, F.col("icao24"), sc.opt_str("site"), sc.region_of("last.customer_region"), F.lit("medium"), callsign=sc.opt_str("last.callsign"), duration_minutes=F.bround("minutes", 1), distinct_heading_sectors=F.col("sectors"), snapshots=F.col("n"))


class WeatherImpact(Rule):
    case_type, window_minutes = "weather_impact", 60

    def detect(self, ctx: Context) -> DataFrame:
        df = ctx.conditions.filter(F.col("flight_category").isin("IFR", "LIFR"))
        severity = F.when(F.col("flight_category") == "LIFR", "high").otherwise("medium")
        return self.found(df, F.lit(""), F.col("site_icao"), F.lit("all"), severity, flight_category=F.col("flight_category"), ceiling_ft=F.col("ceiling_ft"), visibility_sm=F.col("visibility_sm"), wind_kt=F.col("wind_kt"))

    def key(self, site, icao24, facts):
        return [site, fact(facts, "flight_category")]


class GoAround(Rule):
    case_type, window_minutes, radius_nm = "go_around", 30, 10

    def detect(self, ctx: Context, radius_nm: float = radius_nm, floor_ft: int = 3_000, descent_ft: int = 1_000, climb_ft: int = 1_000, min_fixes: int = 3) -> DataFrame:
        near = _near(ctx, radius_nm) if ctx.written else cut(_near(ctx, radius_nm))
        lowest = near.filter("altitude_ft is not null").groupBy("icao24").agg(F.min(F.struct("altitude_ft", "ts_polled")).alias("_low"))
        df = near.join(lowest, "icao24", "left")  # one row an aircraft that comes near a site
        before = F.max(F.when(F.col("ts_polled") < F.col("_low.ts_polled"), F.col("altitude_ft"))).alias("before")
        after = F.max(F.when(F.col("ts_polled") > F.col("_low.ts_polled"), F.col("altitude_ft"))).alias("after")
        df = df.groupBy("icao24").agg(F.count("*").alias("n"), F.first("_low.altitude_ft").alias("low"), before, after, *_near_summary(near))
        df = df.withColumns({"descent": F.col("before") - F.col("low"), "climb": F.col("after") - F.col("low")})
        df = df.filter((F.col("n") >= min_fixes) & (F.col("low") <= floor_ft) & (F.col("descent") >= descent_ft) & (F.col("climb") >= climb_ft) & ~sc.is_ga("last.callsign"))
        return self.found(df, F.col("icao24"), sc.opt_str("site"), sc.region_of("last.customer_region"), F.lit("medium"), callsign=sc.opt_str("last.callsign"), min_altitude_ft=F.col("low"), descent_ft=F.col("descent"), climb_ft=F.col("climb"))


class BaselineProvider:
    """Expected duration of city pairs (U2); only the heuristic one exists."""

    def expected(self, df: DataFrame, airports: DataFrame) -> DataFrame:
        """``df`` with ``expected_minutes``."""
        raise NotImplementedError


class HeuristicBaseline(BaselineProvider):
    def expected(self, df: DataFrame, airports: DataFrame) -> DataFrame:
        return joins.with_baseline(df, airports)


def baseline_provider(name: str = "heuristic") -> BaselineProvider:
    if name != "heuristic":
        raise ValueError(f"no baseline provider {name!r}")
    return HeuristicBaseline()


class Delay(Rule):
    case_type, window_minutes = "delay", 240

    def detect(self, ctx: Context, factor: float = 1.3, provider: str = "heuristic") -> DataFrame:
        df = _now(_latest(ctx), ctx)
        df = df.filter(~F.col("on_ground") & sc.opt_str("origin_icao").isNotNull() & sc.opt_str("destination_icao").isNotNull() & F.col("departure_time").isNotNull())
        df = baseline_provider(provider).expected(df, ctx.airports).withColumn("_elapsed", sc.minutes_between("_now", "departure_time"))
        df = df.filter(F.col("_elapsed") > F.col("expected_minutes") * factor)
        return self.found(df, F.col("icao24"), F.col("destination_icao"), sc.region_of("customer_region"), F.lit("medium"), callsign=sc.opt_str("callsign"), origin=F.col("origin_icao"), destination=F.col("destination_icao"), elapsed_minutes=F.bround("_elapsed", 1), expected_minutes=F.bround("expected_minutes", 1))

    def key(self, site, icao24, facts):
        return [icao24, fact(facts, "destination")]


#: Rules in the order in which they run.
REGISTRY: tuple[Rule, ...] = (LostSignal(), Diversion(), ExcessiveHold(), WeatherImpact(), GoAround(), Delay())


def run_rules(ctx: Context, rules: tuple[Rule, ...] = REGISTRY) -> DataFrame:
    """Findings of all rules; the newest rows and the fixes that rules over time read are materialised once."""
    # airborne fixes within the widest radius of a rule: what is written is a small part of the feed
    reach = max(ctx.options.get(r.case_type, {}).get("radius_nm", r.radius_nm) for r in (ExcessiveHold(), GoAround()))
    known = {r.case_type for r in rules} <= {r.case_type for r in REGISTRY}
    near = ctx.near if ctx.near is not None else ctx.positions
    near = _near(ctx, reach) if known else near.select(*(c for c in NEAR if c in near.columns))
    ctx = replace(ctx, near=cut(near), latest=cut(_latest(ctx)), written=True)
    return reduce(DataFrame.unionByName, (r.detect(ctx, **ctx.options.get(r.case_type, {})) for r in rules))


def batch_dedup(anomalies: DataFrame, rules: tuple[Rule, ...] = REGISTRY) -> DataFrame:
    """The first anomaly of each key in rule order, then by aircraft and site."""
    place = sc.lookup("rule", {r.case_type: str(i) for i, r in enumerate(rules)})
    w = Window.partitionBy("dedup_key").orderBy(place.cast("int"), "icao24", "site_icao", "detection_facts")
    return anomalies.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def case_keys(cases: DataFrame, rules: tuple[Rule, ...] = REGISTRY) -> DataFrame:
    """Open cases with their ``dedup_key`` and suppression window in minutes."""
    cases = cases.filter(~F.col("status").isin("resolved", "closed"))
    key = reduce(lambda c, r: c.when(F.col("case_type") == r.case_type, r.dedup_key("site_icao", "flight_id", "detection_facts")), rules, F.when(F.lit(False), F.lit(None).cast("string")))
    window = sc.lookup("case_type", {r.case_type: str(r.window_minutes) for r in rules}).cast("int")
    return cases.withColumns({"dedup_key": key, "window_minutes": window})


def suppress_existing(anomalies: DataFrame, cases: DataFrame, now: Column, rules: tuple[Rule, ...] = REGISTRY) -> DataFrame:
    """Anomalies without an open case of the same key inside the rule's window.

    The site is compared with null as '', on both sides.
    """
    held = case_keys(cases, rules).filter(sc.minutes_between(now, "created_at") <= F.col("window_minutes")).select("dedup_key").distinct()
    return anomalies.join(held, "dedup_key", "left_anti")


def enrich(positions: DataFrame, plans: DataFrame, sites: DataFrame, rows: list | None = None) -> DataFrame:
    """Last fix in the feed, in-scope rows only, plans and nearest watched site."""
    df = joins.with_feed_last(positions).filter("customer_region is not null")
    return joins.nearest_site(joins.with_plans(df, plans), sites, rows)


def enriched_context(positions: DataFrame, plans: DataFrame, sites: DataFrame, conditions: DataFrame, cells: DataFrame, airports: DataFrame, options: dict[str, dict] | None = None) -> Context:
    """Context over a feed: aircraft are reduced to their newest rows before plans and sites are attached."""
    scoped, rows = positions.filter("customer_region is not null"), joins.site_rows(sites)
    latest = joins.nearest_site(joins.with_plans(newest_rows(positions, feed=True), plans), sites, rows)
    now = scoped.agg(F.max("ts_polled").alias("_now"))
    return Context(enrich(positions, plans, sites, rows), conditions, cells, airports, options or {}, latest, joins.nearest_site(scoped, sites, rows), now)


def detect(ctx: Context, cases: DataFrame, now: Column, rules: tuple[Rule, ...] = REGISTRY) -> DataFrame:
    """All rules, each finding once, without what is open already."""
    return suppress_existing(batch_dedup(run_rules(ctx, rules), rules), cases, now, rules)
