"""Enrichment and matching joins.

Reference tables are joined plainly; Spark broadcasts a side whose measured size is
under its own threshold.  Only tables that are one row a watched site are hinted, and
``nearest_site`` checks their count first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import scalars as sc
from ..shared import cut

#: Sites that are folded as one literal list for each row; more meet the rows by cell first.
MAX_SITES = 2_000
INFER_NM = 50.0


def with_plans(positions: DataFrame, plans: DataFrame) -> DataFrame:
    """Positions with origin, destination and departure of successfully fetched plans."""
    cols = ["origin_icao", "destination_icao", "departure_time"]
    return positions.drop(*cols).join(plans.filter("fetch_status = 'success'").select("icao24", *cols), "icao24", "left")


def _unit(lat: float, lon: float) -> tuple[float, float, float]:
    a, b = math.radians(lat), math.radians(lon)
    return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)


def _folded(df: DataFrame, rows: list, out: str) -> DataFrame:
    """``df`` with ``out``: struct(icao, lat, lon) of the nearest of the ``rows``, null without coordinates.

    Points are unit vectors, and the nearest one has the largest dot product: three products a site,
    trigonometry once a row.  The list is a literal, and the fold stands in a generator, so a filter
    on what it finds never evaluates it a second time.
    """
    sites = F.array(*(F.struct(F.lit(r["icao"]).alias("icao"), F.lit(float(r["lat"])).alias("lat"), F.lit(float(r["lon"])).alias("lon")) for r in rows))
    units = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("xyz", _unit(float(r["lat"]), float(r["lon"]))))) for r in rows))
    la, lo = F.radians("lat"), F.radians("lon")
    point = F.array(F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z")))
    near = F.transform(point, lambda p: F.transform(units, lambda u: p["x"] * u["x"] + p["y"] * u["y"] + p["z"] * u["z"]))
    return df.withColumn(out, F.explode(F.transform(near, lambda d: F.get(sites, (F.array_position(d, F.array_max(d)) - 1).cast("int")))))


def site_rows(sites: DataFrame) -> list:
    """``icao, lat, lon`` of the sites by ICAO, at most one more than MAX_SITES."""
    return sites.filter("lat is not null and lon is not null").select("icao", "lat", "lon").orderBy("icao").limit(MAX_SITES + 1).collect()


def nearest_site(positions: DataFrame, sites: DataFrame, rows: list | None = None) -> DataFrame:
    """``positions`` with the nearest of ``sites(icao, lat, lon)`` and its distance in nm.

    Up to MAX_SITES sites ride along as one array literal and each row folds over it, which needs no
    join.  More sites meet positions by cell: neighbouring cells of 1 and of 8 degrees, as long as
    nothing outside them can be nearer; the rest folds over the sites in lists.  The first site by
    ICAO wins a tie; null coordinates give nulls.  ``rows`` spares reading the sites again.
    """
    rows = site_rows(sites) if rows is None else rows
    names = ("nearest_site_icao", "nearest_site_distance_nm")
    if not rows:
        return positions.withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(None).cast("double")})
    if len(rows) > MAX_SITES:
        return _nearest_by_cell(positions, sites, names)
    df = _folded(positions, rows, "_site")
    return df.withColumns({names[0]: F.col("_site.icao"), names[1]: geo.haversine("lat", "lon", "_site.lat", "_site.lon")}).drop("_site")


def _nearest_by_cell(positions: DataFrame, sites: DataFrame, names: tuple[str, str]) -> DataFrame:
    keyed = cut(positions.withColumn("_row", F.monotonically_increasing_id()))  # written once, so a row keeps its number
    sites = sites.filter("lat is not null and lon is not null").select("icao", "lat", "lon")
    found, open_ = None, keyed.select("_row", "lat", "lon").filter("lat is not null and lon is not null")
    for degrees in (1, 8):
        bucket = lambda x: F.floor(F.col(x) / degrees)  # noqa: B023, E731
        round_ = lambda c: F.pmod(c, F.lit(360 // degrees))  # noqa: B023, E731  longitudes meet at 180 degrees
        ring = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        at = open_.withColumn("_r", ring).select("_row", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), (bucket("lat") + F.col("_r.a")).alias("c1"), round_(bucket("lon") + F.col("_r.b")).alias("c2"))
        near = at.join(sites.select("icao", "lat", "lon", bucket("lat").alias("c1"), round_(bucket("lon")).alias("c2")), ["c1", "c2"])
        best = near.groupBy("_row").agg(F.min(F.struct(geo.haversine("p_lat", "p_lon", "lat", "lon").alias("nm"), "icao")).alias("best"), F.first("p_lat").alias("p_lat"))
        # a site outside the ring is a cell away, of which cells near a pole are narrow: the sine rule bounds it from below
        edge = geo.NM_RADIUS * F.asin(F.sin(F.radians(F.lit(float(degrees)))) * F.cos(F.radians(F.least(F.abs("p_lat"), F.lit(90.0)))))
        sure = cut(best.filter(F.col("best.nm") < edge).select("_row", "best"))
        found = sure if found is None else found.unionByName(sure)
        open_ = cut(open_.join(sure, "_row", "left_anti"))
    rest, left = None, open_
    if not open_.isEmpty():
        listed = sites.orderBy("icao").collect()  # an icao and a coordinate a site
        for i in range(0, len(listed), MAX_SITES):
            left = cut(_folded(left.drop("_site"), listed[i : i + MAX_SITES], "_site"))
            one = left.select("_row", F.struct(geo.haversine("lat", "lon", "_site.lat", "_site.lon").alias("nm"), F.col("_site.icao").alias("icao")).alias("best"))
            rest = one if rest is None else rest.unionByName(one)
        found = found.unionByName(rest.groupBy("_row").agg(F.min("best").alias("best")))
    out = keyed.join(found, "_row", "left")
    return out.withColumns({names[0]: F.col("best.icao"), names[1]: F.col("best.nm")}).drop("best", "_row")


def infer_region(positions: DataFrame, sites: DataFrame, max_nm: float = INFER_NM) -> DataFrame:
    """``positions`` with ``customer_region`` of the nearest watched site within ``max_nm``."""
    df = nearest_site(positions, sites)
    regions = sites.select(F.col("icao").alias("nearest_site_icao"), sc.collapse_region("customer_regions").alias("_region"))
    df = df.join(regions, "nearest_site_icao", "left")
    return df.withColumn("customer_region", F.when(F.col("nearest_site_distance_nm") <= max_nm, F.col("_region"))).drop("_region")


def with_type(positions: DataFrame, registry: DataFrame) -> DataFrame:
    """``positions`` with a known aircraft type."""
    return positions.join(registry.filter("aircraft_type is not null").select("icao24", "aircraft_type"), "icao24", "left")


def apply_denylist(df: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows whose id starts with none of the prefixes.

    Prefixes differ in length only by a few values, so each length is one equi-join.
    """
    listed = prefixes.filter("prefix <> ''").distinct()
    for (n,) in listed.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect():  # id lengths: six at most
        some = listed.filter(F.length("prefix") == n).withColumnRenamed("prefix", "_prefix")
        df = df.join(some, F.substring("icao24", 1, n) == F.col("_prefix"), "left_anti")
    return df


def flight_detail(current: DataFrame, registry: DataFrame, now: Column, minutes: int = 30, icao24: str | None = None) -> DataFrame:
    df = sc.seen_within(current, minutes, now)
    df = df if icao24 is None else df.filter(F.col("icao24") == icao24)
    return df.join(registry, "icao24", "left")


def site_detail(airports: DataFrame, conditions: DataFrame, flows: DataFrame, cases: DataFrame) -> DataFrame:
    """Airport, its weather, flow counts and active cases."""
    weather = conditions.withColumnRenamed("site_icao", "icao")
    active = cases.filter(F.col("status").isin(*sc.OPEN_STATUSES)).groupBy(F.col("site_icao").alias("icao")).agg(F.count("*").alias("active_case_count"))
    out = airports.join(weather, "icao", "left").join(flows, "icao", "left").join(active, "icao", "left")
    return out.fillna(0, ["inbound_count_60m", "outbound_count_60m", "active_case_count"])


def merge_site(detail: DataFrame, sla: DataFrame) -> DataFrame:
    """Site detail with its scorecard; the category of the scorecard wins, a site without one stays."""
    renamed = sla.select("icao", *(F.col(c).alias(f"sla_{c}") for c in sla.columns if c != "icao"))
    out = detail.join(renamed, "icao", "left")
    return out.withColumn("flight_category", F.coalesce("sla_flight_category", "flight_category"))


def conditions(metar: DataFrame, taf: DataFrame) -> DataFrame:
    """METAR with TAF by station, ceiling and flight category (J8); of a station's forecasts the largest text counts."""
    once = taf.groupBy("site_icao").agg(F.max("taf_raw").alias("taf_raw"))
    df = metar.join(once, "site_icao", "left").withColumn("ceiling_ft", sc.ceiling_ft("clouds"))
    return df.withColumn("flight_category", sc.flight_category("ceiling_ft", "visibility_sm"))


def with_baseline(positions: DataFrame, airports: DataFrame) -> DataFrame:
    """``positions`` with ``expected_minutes`` of its city pair; null for unknown or equal airports."""
    side = lambda end: airports.filter("lat is not null and lon is not null").select(F.col("icao").alias(f"{end}_icao"), F.col("lat").alias(f"_{end}_lat"), F.col("lon").alias(f"_{end}_lon"))
    df = positions.join(side("origin"), "origin_icao", "left").join(side("destination"), "destination_icao", "left")
    nm = geo.haversine("_origin_lat", "_origin_lon", "_destination_lat", "_destination_lon")
    df = df.withColumn("expected_minutes", F.when(F.col("origin_icao") != F.col("destination_icao"), geo.expected_minutes(nm)))
    return df.drop(*(f"_{e}_{c}" for e in ("origin", "destination") for c in ("lat", "lon")))


def with_sparse(df: DataFrame, cells: DataFrame) -> DataFrame:
    """``df`` with ``sparse``: its whole-degree cell is in ``cells(lat_cell, lon_cell)``."""
    marked = cells.select(F.col("lat_cell").alias("_lat"), F.col("lon_cell").alias("_lon")).distinct().withColumn("sparse", F.lit(True))
    out = df.join(marked, (geo.cell("lat") == F.col("_lat")) & (geo.cell("lon") == F.col("_lon")), "left")
    return out.withColumn("sparse", F.coalesce("sparse", F.lit(False))).drop("_lat", "_lon")


def with_runbooks(cases: DataFrame, runbooks: DataFrame) -> DataFrame:
    """``cases`` with the sorted ids of the runbooks for their type."""
    refs = runbooks.select(F.explode("case_types").alias("case_type"), "runbook_id").groupBy("case_type").agg(F.sort_array(F.collect_set("runbook_id")).alias("runbook_refs"))
    return cases.join(refs, "case_type", "left").withColumn("runbook_refs", F.coalesce("runbook_refs", F.array().cast("array<string>")))


def stale_plans(current: DataFrame, plans: DataFrame, now: Column, hours: int = 12, cap: int = 30) -> DataFrame:
    """Aircraft whose plan is missing or older than ``hours``, never fetched first, at most ``cap``."""
    return stale_candidates(current, plans, now, hours).orderBy(F.asc_nulls_first("refreshed_at"), "icao24").limit(cap)


def stale_candidates(current: DataFrame, plans: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    df = current.filter(F.col("customer_region").isNotNull()).select("icao24").distinct().join(plans.select("icao24", "refreshed_at"), "icao24", "left")
    return df.filter(F.col("refreshed_at").isNull() | (F.col("refreshed_at") < now - F.expr(f"interval {int(hours)} hours")))


def match_cases(crm: DataFrame, cases: DataFrame) -> DataFrame:
    """CRM rows with the ``case_id`` they mean: by CRM id, else by external id."""
    by_crm = crm.join(cases.filter("salesforce_id is not null").select("salesforce_id", F.col("case_id").alias("_a")), "salesforce_id", "left")
    out = by_crm.join(cases.select(F.col("case_id").alias("_b")), F.col("external_id") == F.col("_b"), "left")
    return out.withColumn("case_id", F.coalesce("_a", "_b")).drop("_a", "_b")


def with_feed_last(positions: DataFrame, ts: str = "ts_polled") -> DataFrame:
    """``feed_last_ts``: each aircraft's newest fix in the whole feed; call before any scope filter."""
    last = positions.groupBy("icao24").agg(F.max(ts).alias("feed_last_ts"))
    return positions.join(last, "icao24")


def only_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("icao24").distinct(), "icao24", "left_semi")


def case_detail(cases: DataFrame, timeline: DataFrame) -> DataFrame:
    """Cases with their timeline as an ordered array."""
    events = timeline.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("occurred_at", "event_id", "event_type"))).alias("events"))
    return cases.join(events, "case_id", "left")


def triage_tasks(cases: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Investigation, escalation and notification tasks of each case."""
    steps = runbooks.select("runbook_id", F.explode("case_types").alias("case_type"), sc.manual_steps("triage_steps").alias("steps"))
    # Kinds, priorities and the prefixes of the subjects.
    plain = F.lit("Normal")
    subject = sc.case_subject("case_type", "site_icao", "detection_facts")
    short = lambda c: F.when(F.length(c) > 255, F.concat(F.substring(c, 1, 252), F.lit("..."))).otherwise(c)
    work = cases.join(steps, "case_type").select("case_id", F.explode("steps").alias("step")).select("case_id", F.lit("investigation").alias("kind"), short(F.col("step")).alias("subject"), plain.alias("priority"))
    fact = lambda k: F.get_json_object("detection_facts", f"$.{k}").try_cast("double")
    critical = cases.filter((F.col("case_type") == "lost_signal") & (fact("gap_minutes") > 30) & (fact("last_altitude_ft") > 10_000))
    critical = critical.select("case_id", F.lit("escalation").alias("kind"), short(F.concat(F.lit("CRITICAL ESCALATION: "), subject)).alias("subject"), F.lit("High").alias("priority"))
    scoped = cases.filter("customer_region is not null and trim(customer_region) <> '' and lower(customer_region) <> 'all'")
    scoped = scoped.select("case_id", F.lit("notification").alias("kind"), short(F.concat(F.lit("Customer notification — "), subject)).alias("subject"), plain.alias("priority"))
    return work.unionByName(critical).unionByName(scoped)


def runbook_links(cases: DataFrame, runbooks: DataFrame, documents: DataFrame, existing: DataFrame) -> DataFrame:
    """New ``case_id, document_id`` links by runbook title, without those that exist."""
    titled = runbooks.select(F.explode("case_types").alias("case_type"), "title").join(documents, "title")
    links = cases.select("case_id", "case_type").join(titled, "case_type").select("case_id", "document_id").distinct()
    return links.join(existing, ["case_id", "document_id"], "left_anti")


def missing_sites(watchlist: DataFrame, airports: DataFrame) -> DataFrame:
    return watchlist.join(airports, "icao", "left_anti").select("icao")
