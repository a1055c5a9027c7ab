"""Gauges, reports and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import scalars as sc


def _count(name: str = "n") -> Column:
    return F.count("*").alias(name)


def in_scope_aircraft(positions: DataFrame) -> DataFrame:
    return positions.filter("customer_region is not null").agg(F.countDistinct("icao24").alias("n_aircraft"))


def by_rule(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("rule").agg(_count())


def build_sparse_cells(cases: DataFrame, min_fires: int = 8, min_callsigns: int = 6) -> DataFrame:
    """Whole-degree cells with many lost-signal cases of many callsigns (A4)."""
    fact = lambda k: F.get_json_object("detection_facts", f"$.{k}")
    df = cases.filter("case_type = 'lost_signal'").select(geo.cell(fact("last_lat").try_cast("double")).alias("lat_cell"), geo.cell(fact("last_lon").try_cast("double")).alias("lon_cell"), fact("callsign").alias("callsign"))
    df = df.filter("lat_cell is not null and lon_cell is not null").groupBy("lat_cell", "lon_cell").agg(_count("fires"), F.countDistinct("callsign").alias("callsigns"))
    return df.filter((F.col("fires") >= min_fires) & (F.col("callsigns") >= min_callsigns))


def fleet_gauges(current: DataFrame, now: Column) -> DataFrame:
    """Aircraft seen in 15 minutes, aircraft tracked, seconds since the newest fix; -1 without rows (A5)."""
    recent = F.col("last_seen_at") >= now - F.expr("interval 15 minutes")
    lag = sc.epoch(F.first(now)) - sc.epoch(F.max("last_seen_at"))
    return current.agg(F.count_if(recent).alias("active"), _count("tracked"), F.coalesce(F.greatest(lag, F.lit(0)), F.lit(-1)).cast("long").alias("lag_seconds"))


def cases_cube(cases: DataFrame) -> DataFrame:
    """Counts by severity and status, region, type, type and severity, in one pass.

    ``grouping`` names the set; a null severity is 'unknown'.
    """
    df = cases.withColumn("severity", F.coalesce("severity", F.lit("unknown")))
    sets = df.groupingSets([["severity", "status"], ["customer_region"], ["case_type"], ["case_type", "severity"]], "severity", "status", "customer_region", "case_type")
    bits = F.grouping_id("severity", "status", "customer_region", "case_type")
    names = {0b0011: "severity_status", 0b1101: "region", 0b1110: "type", 0b0110: "type_severity"}
    out = sets.agg(bits.alias("_g"), _count())
    which = sc.lookup(F.col("_g").cast("string"), {str(k): v for k, v in names.items()})
    return out.withColumn("grouping", which).drop("_g")


def created_since(cases: DataFrame, now: Column, hours: int) -> DataFrame:
    return cases.filter((F.col("created_at") >= now - F.expr(f"interval {int(hours)} hours")) & (F.col("created_at") <= now))


def cases_created_24h(cases: DataFrame, now: Column) -> DataFrame:
    return created_since(cases, now, 24).groupBy("case_type").agg(_count())


def cases_by_site_topn(cases: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` sites with most cases, the rest as 'other' (A11)."""
    counts = cases.groupBy("site_icao").agg(_count())
    top = counts.orderBy(F.desc("n"), "site_icao").limit(n).select("site_icao", F.lit(True).alias("_top"))
    out = counts.join(F.broadcast(top), "site_icao", "left")  # n rows
    return out.groupBy(F.when(F.col("_top"), F.col("site_icao")).otherwise("other").alias("site")).agg(F.sum("n").alias("n"))


def sync_backlog(cases: DataFrame) -> DataFrame:
    return cases.groupBy("sf_sync_status").agg(_count())


def runs_24h(runs: DataFrame, now: Column) -> DataFrame:
    return runs.filter((F.col("created_at") >= now - F.expr("interval 24 hours")) & (F.col("created_at") <= now)).groupBy("pipeline_name", "status").agg(_count())


def last_run(runs: DataFrame, now: Column) -> DataFrame:
    """Of each pipeline the last completed run: duration and age in seconds."""
    done = runs.filter("status = 'SUCCESS' and end_s is not null").groupBy("pipeline_name").agg(F.max_by(F.struct("start_s", "end_s"), F.struct("end_s", "run_id")).alias("r"))
    return done.select("pipeline_name", (F.col("r.end_s") - F.col("r.start_s")).alias("duration_s"), (sc.epoch(now) - F.col("r.end_s")).alias("age_s"))


def push_health(cases: DataFrame, now: Column, minutes: int = 30, min_n: int = 20, max_rate: float = 0.5) -> DataFrame:
    """Share of failed pushes among finished ones."""
    df = cases.filter((F.col("updated_at") >= now - F.expr(f"interval {int(minutes)} minutes")) & (F.col("updated_at") <= now))
    df = df.agg(F.count_if(F.col("sf_sync_status") == "failed").alias("failed"), F.count_if(F.col("sf_sync_status") == "synced").alias("synced"))
    n = F.col("failed") + F.col("synced")
    df = df.withColumn("rate", F.when(n > 0, F.col("failed") / n).otherwise(0.0))
    return df.withColumn("unhealthy", (n >= min_n) & (F.col("rate") >= max_rate))


def flow_counts(current: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Inbound and outbound aircraft per site, over positions joined with plans; one shuffle."""
    df = sc.seen_within(current, minutes, now)
    ends = F.explode(F.array(F.struct(F.col("destination_icao").alias("icao"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("origin_icao").alias("icao"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    df = df.select(ends.alias("e")).select("e.*").filter("icao is not null")
    return df.groupBy("icao").agg(F.sum("i").alias("inbound_count_60m"), F.sum("o").alias("outbound_count_60m"))


def category_dist(conditions: DataFrame) -> DataFrame:
    return conditions.filter("flight_category is not null").groupBy("flight_category").agg(_count())


def _marked(raw: DataFrame, prefixes: DataFrame, registry: DataFrame) -> tuple[DataFrame, list[Column], Column]:
    """The batch with its marks, the counts of A18 over it, and which rows are kept."""
    from .joins import with_type

    n = [r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]  # id lengths: six at most
    df = raw.withColumn("_denied", F.lit(False))
    for size in n:
        some = prefixes.filter(F.length("prefix") == size).distinct().select(F.col("prefix").alias("_p"), F.lit(True).alias("_hit"))
        df = df.join(some, F.substring("icao24", 1, size) == F.col("_p"), "left").withColumn("_denied", F.col("_denied") | F.coalesce("_hit", F.lit(False))).drop("_p", "_hit")
    df = with_type(df.drop("aircraft_type"), registry)
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    kept = ~F.col("_denied") & located
    counts = [_count("raw"), F.count_if("_denied").alias("denied"), F.count_if(~F.col("_denied") & ~located).alias("no_coords"), F.count_if(kept).alias("kept"), F.count_if(kept & F.col("aircraft_type").isNotNull()).alias("typed")]
    return df, counts, kept


def ingest_stats(raw: DataFrame, prefixes: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows raw, denied, without coordinates, kept, with a type (A18), in one pass over the batch."""
    df, counts, _ = _marked(raw, prefixes, registry)
    return df.agg(*counts)


def observed_ingest(raw: DataFrame, prefixes: DataFrame, registry: DataFrame, observation: Observation) -> DataFrame:
    """The kept rows; writing them also counts the batch into ``observation`` (A18 without a second pass)."""
    df, counts, kept = _marked(raw, prefixes, registry)
    return df.observe(observation, *counts).filter(kept).drop("_denied")


def open_cases(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.col("status").isin("resolved", "closed"))


def report_open_by_rule(cases: DataFrame) -> DataFrame:
    return open_cases(cases).groupBy("case_type").agg(_count()).orderBy(F.desc("n"), "case_type")


def report_severity_mix(cases: DataFrame) -> DataFrame:
    return open_cases(cases).groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(_count())


def report_per_site(cases: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return created_since(cases, now, 24 * days).groupBy("site_icao").agg(_count())


def report_per_aircraft(cases: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return created_since(cases, now, 24 * days).groupBy("flight_id").agg(_count())


def report_mttr(cases: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Mean hours to resolve by rule, of cases resolved in the window."""
    df = cases.filter((F.col("resolved_at") >= now - F.expr(f"interval {int(days)} days")) & (F.col("resolved_at") <= now))
    return df.groupBy("case_type").agg(F.avg(sc.resolution_hours("created_at", "resolved_at")).alias("mean_hours"))


def report_created_daily(cases: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return created_since(cases, now, 24 * days).groupBy(F.date_trunc("day", "created_at").alias("day")).agg(_count())


def kpi_rollups(cases: DataFrame, top: int = 15) -> DataFrame:
    """Open cases in all, by severity, and of the ``top`` sites, as ``kpi, label, n``."""
    df = open_cases(cases)
    total = df.agg(_count()).select(F.lit("open_total").alias("kpi"), F.lit("all").alias("label"), "n")
    severity = report_severity_mix(cases).select(F.lit("open_by_severity").alias("kpi"), F.col("severity").alias("label"), "n")
    sites = df.groupBy("site_icao").agg(_count()).orderBy(F.desc("n"), "site_icao").limit(top).select(F.lit("top_sites").alias("kpi"), F.col("site_icao").alias("label"), "n")
    return total.unionByName(severity).unionByName(sites)


def request_kpis(log: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Rate, error rate and exact p95 latency by handler and window (A27 to A29); also for streams."""
    by, errors = [F.window("ts", width).alias("w"), "handler"], F.count_if(F.col("status") != 200).alias("errors")
    if log.isStreaming:  # state is how often each latency of an open window came
        df = log.groupBy(*by).agg(_count(), errors, F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_seconds)").alias("p95_s"))
    else:  # equal latencies become one row each, which are sorted and counted up; a sort spills
        each = log.groupBy(*by, "duration_seconds").agg(_count(), errors)
        window, known = Window.partitionBy("w", "handler"), F.when(F.col("duration_seconds").isNotNull(), F.col("n"))
        each = each.withColumns({"_up_to": F.sum(known).over(window.orderBy("duration_seconds")), "_all": F.sum(known).over(window)})
        p95 = F.min(F.when(100 * F.col("_up_to") >= 95 * F.col("_all"), F.col("duration_seconds")))
        df = each.groupBy("w", "handler").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), p95.alias("p95_s"))
    seconds = sc.epoch("w.end") - sc.epoch("w.start")
    return df.select(F.col("w.start").alias("window_start"), "handler", "n", (F.col("n") / seconds).alias("rate"), (F.col("errors") / F.col("n")).alias("error_rate"), "p95_s")


def window_sketches(log: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Request KPIs that can be merged: counts, and a KLL sketch of the latencies, by handler and window."""
    df = log.groupBy(F.window("ts", width).alias("w"), "handler")
    df = df.agg(_count(), F.count_if(F.col("status") != 200).alias("errors"), F.kll_sketch_agg_double("duration_seconds", F.lit(200)).alias("latency"))
    return df.select(F.col("w.start").alias("window_start"), "handler", "n", "errors", "latency")


def merged_kpis(sketches: DataFrame, width: str = "1 hour", q: float = 0.95) -> DataFrame:
    """KPIs of longer windows from ``window_sketches``, without the log: the p95 has a rank error of about 1.7 %."""
    df = sketches.groupBy(F.window("window_start", width).alias("w"), "handler")
    df = df.agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("latency").alias("latency"))
    return df.select(F.col("w.start").alias("window_start"), "handler", "n", (F.col("errors") / F.col("n")).alias("error_rate"), F.kll_sketch_get_quantile_double("latency", F.lit(q)).alias("p95_s"))


def aircraft_sketches(positions: DataFrame, width: str = "5 minutes") -> DataFrame:
    """A HyperLogLog sketch of the aircraft of each window; ``hll_union_agg`` merges them (A2)."""
    df = positions.groupBy(F.window("ts_polled", width).alias("w")).agg(F.hll_sketch_agg("icao24").alias("aircraft"))
    return df.select(F.col("w.start").alias("window_start"), "aircraft")


def log_filter(log: DataFrame, pattern: str, column: str = "props") -> DataFrame:
    """Log lines that are JSON objects and match the pattern without regard to case."""
    return log.filter(F.from_json(column, "map<string,string>").isNotNull() & F.col(column).rlike(f"(?i){pattern}"))


def sync_summary(outcomes: DataFrame) -> DataFrame:
    """Attempted, synced, retrying, failed."""
    is_ = lambda s: F.count_if(F.col("result") == s).alias(s)
    return outcomes.agg(_count("attempted"), is_("synced"), is_("retrying"), is_("failed"))


def pull_summary(matched: DataFrame) -> DataFrame:
    return matched.agg(_count("fetched"), F.count_if(F.col("case_id").isNotNull()).alias("updated"), F.count_if(F.col("case_id").isNull()).alias("unmatched"))


def site_sla(airports: DataFrame, conditions: DataFrame, flows: DataFrame, cases: DataFrame, period: str = "60m") -> DataFrame:
    """Scorecard of each site; on-time figures are declared without a source and are typed nulls."""
    from .joins import site_detail

    df = site_detail(airports, conditions, flows, cases).withColumn("flight_category", F.coalesce("flight_category", F.lit("VFR")))
    none = [F.lit(None).cast("double").alias(c) for c in ("on_time_arrival_pct", "on_time_departure_pct", "avg_arrival_delay_min", "avg_departure_delay_min")]
    return df.select("icao", F.lit(period).alias("period"), "flight_category", sc.weather_impact("flight_category").alias("weather_impact"), F.col("active_case_count").alias("active_cases"), F.col("inbound_count_60m").alias("inbound_count"), F.col("outbound_count_60m").alias("outbound_count"), *none)


def enrichment_stats(fetched: DataFrame, n_candidates: DataFrame, cap: int) -> DataFrame:
    """Candidates, attempts, outcomes, deferred (A33); ``n_candidates`` is one row with ``candidates``."""
    is_ = lambda s: F.count_if(F.col("fetch_status") == s).alias(s)
    out = fetched.agg(_count("attempts"), is_("success"), is_("not_found"), is_("error")).crossJoin(n_candidates)  # one row by one row
    return out.withColumn("deferred", F.greatest(F.col("candidates") - cap, F.lit(0)))
