"""Keyed state with event-time timers and time to live (T2, T4, T5, T6 with J12, T11 with X15 and W8).

The state of one key is small and of its own; the state store holds all of them, checkpoints their changes and
brings them back on another executor.  Nothing is rewritten but the keys of a batch, and timers fire from the
watermark alone, whether the key has rows in the batch or not.  All of these need the RocksDB state store.
Times travel as milliseconds; a timer is set one millisecond past the time it is about, so what happens at
that very time still counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as sc
from ..operators import rules

MINUTE = 60_000


def _ms(ts: str | Column) -> Column:
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


class _Timed(StatefulProcessor):
    """A processor with one timer a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def move_timer(self, before: int | None, ms: int | None) -> None:
        """As ``set_timer``, where the state tells the time that is set."""
        if before != ms:
            if before is not None:
                self.handle.deleteTimer(before + 1)
            if ms is not None:
                self.handle.registerTimer(ms + 1)

    def set_timer(self, ms: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ms is not None:
            self.handle.registerTimer(ms + 1)

    def close(self) -> None:
        pass


# -- T4: silence ----------------------------------------------------------------------------------


class Gaps(_Timed):
    """State of one aircraft: its last fix, and how far its silence has been told (0 not, 1 begun)."""

    def __init__(self, low_ms: int, high_ms: int):
        self.low_ms, self.high_ms = low_ms, high_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("fix", "last_ms bigint, told int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times: set[int] = set()
        for pdf in rows:
            times.update(map(int, pdf["ms"]))
        last, told = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for ms in sorted(times):
            if last is not None and ms <= last:
                continue  # late: what is known is newer
            if last is not None and ms > last + self.low_ms:
                if told == 0:
                    out.append((key[0], "silent", last + self.low_ms))
                out.append((key[0], "lost", last + self.high_ms) if ms > last + self.high_ms else (key[0], "back", ms))
            last, told = ms, 0
        self.state.update((last, told))
        self.set_timer(last + (self.high_ms if told else self.low_ms))
        yield pd.DataFrame(out, columns=["icao24", "kind", "ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.state.get()
        out = []
        if told == 0:
            out.append((key[0], "silent", last + self.low_ms))
            if timerValues.getCurrentWatermarkInMs() <= last + self.high_ms:
                self.state.update((last, 1))
                self.set_timer(last + self.high_ms)
                yield pd.DataFrame(out, columns=["icao24", "kind", "ms"])
                return
        out.append((key[0], "lost", last + self.high_ms))
        self.state.clear()
        yield pd.DataFrame(out, columns=["icao24", "kind", "ms"])


def stream_silence(positions: DataFrame, low: int = 14, high: int = 30, delay: str = "0 seconds") -> DataFrame:
    """``icao24, kind, told_at``: aircraft that fall silent for ``low`` minutes, and then come back or are lost after ``high`` (T4).

    A lost aircraft is forgotten.  Rows later than ``delay`` behind the newest fix are dropped.
    """
    rows = positions.withWatermark("ts_polled", delay).select("icao24", "ts_polled", _ms("ts_polled").alias("ms"))
    out = rows.groupBy("icao24").transformWithStateInPandas(Gaps(low * MINUTE, high * MINUTE), "icao24 string, kind string, ms long", "Append", "EventTime")
    return out.select("icao24", "kind", F.timestamp_millis("ms").alias("told_at"))


# -- T5: rules over the sliding window ------------------------------------------------------------

_FIX = ("ms", "tie", "callsign", "customer_region", "altitude_ft", "sector", "site", "nm")
_FOUND = "rule string, icao24 string, ms long, site_icao string, customer_region string, callsign string, n long, minutes double, sectors long, min_altitude_ft long, descent_ft long, climb_ft long"

_FOUND_ROW = Row(*(c.split()[0] for c in _FOUND.split(", ")))


class NearSite(_Timed):
    """State of one aircraft: its airborne fixes near a site, none older than the window, and the slide told last."""

    def __init__(self, options: dict[str, dict], window_ms: int, slide_ms: int):
        self.hold = {"radius_nm": 15, "ceiling": 15_000, "min_minutes": 30, "min_fixes": 10, "min_sectors": 6} | options.get("excessive_hold", {})
        self.around = {"radius_nm": 10, "floor_ft": 3_000, "descent_ft": 1_000, "climb_ft": 1_000, "min_fixes": 3} | options.get("go_around", {})
        self.window_ms, self.slide_ms = window_ms, slide_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.told = handle.getValueState("told", "slide_ms bigint")
        self.fixes = handle.getListState("fixes", "ms bigint, tie bigint, callsign string, customer_region string, altitude_ft int, sector int, site string, nm double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._slides(key[0], [tuple(r[c] for c in _FIX) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._slides(key[0], [], timerValues.getCurrentWatermarkInMs())

    def _next(self, first_ms: int, told: int) -> int:
        """The first slide not told yet whose window a fix of that time may be in."""
        return max(-(-first_ms // self.slide_ms) * self.slide_ms, told + self.slide_ms)

    def _slides(self, icao24: str, new: list[tuple], watermark: int) -> Iterator[Row]:
        """Findings at the slides that the watermark has passed; the fixes of later ones stay."""
        stored = [tuple(f) for f in self.fixes.get()]
        out, told = [], self.told.get()[0] if stored else -1
        timer = self._next(stored[0][0], told) if stored else None
        held = sorted(stored + new, key=lambda f: f[:2])
        times, i, at = [f[0] for f in held], 0, None
        while i < len(held):
            at = self._next(times[i], told)
            if times[i] < at - self.window_ms:
                i += 1
                continue
            if at >= watermark:
                break
            window = held[i : bisect_right(times, at)]
            out += self._hold(icao24, at, window) + self._around(icao24, at, window)
            told = at
        if i < len(held):
            self.fixes.put(held[i:])
            self.told.update((told,))
        elif stored:
            self.fixes.clear()
            self.told.clear()
        self.move_timer(timer, at if i < len(held) else None)
        return map(_FOUND_ROW, *zip(*out)) if out else iter(())

    @staticmethod
    def _summary(near: list[tuple]) -> tuple[str | None, str | None, str | None]:
        """Site (the most frequent, lowest on a tie), region and call sign of the newest fix."""
        sites = Counter(f[6] for f in near if f[6] is not None)
        site = min(sites, key=lambda s: (-sites[s], s)) if sites else None
        return site or None, near[-1][3] or "all", near[-1][2] or None

    def _hold(self, icao24: str, at: int, window: list[tuple]) -> list[tuple]:
        o = self.hold
        near = [f for f in window if f[7] <= o["radius_nm"] and f[4] is not None and f[4] <= o["ceiling"]]
        sectors = len({f[5] for f in near if f[5] is not None})
        minutes = (near[-1][0] - near[0][0]) / MINUTE if near else 0
        if len(near) < o["min_fixes"] or minutes < o["min_minutes"] or sectors < o["min_sectors"]:
            return []
        site, region, callsign = self._summary(near)
        return [] if _is_ga(callsign) else [("excessive_hold", icao24, at, site, region, callsign, len(near), minutes, sectors, None, None, None)]

    def _around(self, icao24: str, at: int, window: list[tuple]) -> list[tuple]:
        o = self.around
        near = [f for f in window if f[7] <= o["radius_nm"]]
        known = [(f[4], f[0]) for f in near if f[4] is not None]
        if len(near) < o["min_fixes"] or not known:
            return []
        low, when = min(known)
        before, after = (max((a for a, ms in known if (ms < when) == early and ms != when), default=low) for early in (True, False))
        if low > o["floor_ft"] or before - low < o["descent_ft"] or after - low < o["climb_ft"]:
            return []
        site, region, callsign = self._summary(near)
        return [] if _is_ga(callsign) else [("go_around", icao24, at, site, region, callsign, len(near), None, None, low, before - low, after - low)]


def _is_ga(callsign: str | None) -> bool:
    return callsign is not None and callsign[:1] == "N" and callsign[1:2].isdigit() and callsign[1:2].isascii()


def stream_near_rules(near: DataFrame, options: dict[str, dict] | None = None, minutes: int = 30, slide: int = 5, delay: str = "0 seconds") -> DataFrame:
    """Holds and go-arounds in the ``minutes`` up to every ``slide`` minutes that the watermark has passed.

    ``near`` is an enriched positions stream (``rules.NEAR``).  State is what one window holds of an aircraft.
    """
    from ..functions.geo import heading_sector

    options = options or {}
    reach = max(options.get("excessive_hold", {}).get("radius_nm", 15), options.get("go_around", {}).get("radius_nm", 10))
    tie = F.col("event_id").cast("long") if "event_id" in near.columns else F.lit(0).cast("long")
    rows = near.withWatermark("ts_polled", delay).filter((F.col("nearest_site_distance_nm") <= reach) & ~F.col("on_ground"))
    rows = rows.select(
        "icao24", "ts_polled", _ms("ts_polled").alias("ms"), tie.alias("tie"), "callsign", "customer_region", F.col("altitude_ft").cast("int").alias("altitude_ft"),
        heading_sector("heading_deg").cast("int").alias("sector"), F.col("nearest_site_icao").alias("site"), F.col("nearest_site_distance_nm").alias("nm"),
    )
    out = rows.groupBy("icao24").transformWithState(NearSite(options, minutes * MINUTE, slide * MINUTE), _FOUND, "Append", "EventTime")
    return out.withColumn("told_at", F.timestamp_millis("ms")).drop("ms")


# -- T6 with J12: suppression that sees resolutions ------------------------------------------------


class Suppress(_Timed):
    """State of one key: creation times of its open cases, by case, and of its own findings that have no case yet (named '')."""

    def __init__(self, windows: dict[str, int], own: bool):
        self.windows, self.own = windows, own

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "case_id string", "created_ms bigint, window_ms bigint")

    def _stored(self) -> dict[str, tuple]:
        return {k[0]: tuple(v) for k, v in self.open.iterator()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = [(r["ms"], r["finding"], r["case_id"], r["created_ms"], r["is_open"], r["rule"]) for r in rows]
        stored = self._stored()
        held, out = dict(stored), []
        # of one time, what happened to cases comes first
        for ms, finding, case_id, created, is_open, rule in sorted(events, key=lambda e: (e[0], e[1] is not None, e[2] or "", e[1] or "")):
            window = self.windows[rule] * MINUTE
            if finding is None:
                if not is_open:
                    held.pop(case_id, None)
                else:
                    held[case_id] = (created, window)
                    if "" in held and held[""][0] <= created:
                        del held[""]  # the finding's own case
            elif all(ms - since > length for since, length in held.values()):
                out.append(Row(dedup_key=key[0], rule=rule, finding=finding, ms=ms))
                if self.own:
                    held[""] = (ms, window)
        self._keep(stored, held, timerValues.getCurrentWatermarkInMs())
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored = self._stored()
        self._keep(stored, stored, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _keep(self, stored: dict[str, tuple], held: dict[str, tuple], watermark: int) -> None:
        """Only entries that can still suppress something stay; the timer is for the next that ends.  What is as stored isn't written."""
        kept = {c: v for c, v in held.items() if sum(v) >= watermark}
        if stored and not kept:
            self.open.clear()
        else:
            for case_id in stored.keys() - kept.keys():
                self.open.removeKey((case_id,))
            for case_id, value in kept.items():
                if stored.get(case_id) != value:
                    self.open.updateValue((case_id,), value)
        self.move_timer(min(map(sum, stored.values()), default=None), min(map(sum, kept.values()), default=None))


def stream_suppress(anomalies: DataFrame, cases: DataFrame, registry: tuple[rules.Rule, ...] = rules.REGISTRY, own: bool = True, delay: str = "0 seconds") -> DataFrame:
    """Findings without an open case of the same key inside their rule's window (T6, J12): ``dedup_key, rule, finding, told_at``.

    ``anomalies`` has ``dedup_key, rule, finding`` (its id) and ``detected_at``; ``cases`` is the stream of case changes
    with ``dedup_key, case_id, case_type, created_at, status`` and ``updated_at``.  A resolved case frees its key at
    once.  With ``own`` a finding suppresses later ones until its case comes.
    """
    found = anomalies.select("dedup_key", F.col("detected_at").alias("ts"), "finding", F.lit(None).cast("string").alias("case_id"), F.lit(None).cast("long").alias("created_ms"), F.lit(None).cast("boolean").alias("is_open"), "rule")
    changed = cases.select("dedup_key", F.col("updated_at").alias("ts"), F.lit(None).cast("string").alias("finding"), "case_id", _ms("created_at").alias("created_ms"), (~F.col("status").isin("resolved", "closed")).alias("is_open"), F.col("case_type").alias("rule"))
    rows = found.unionByName(changed).withWatermark("ts", delay).withColumn("ms", _ms("ts"))
    windows = {r.case_type: r.window_minutes for r in registry}
    out = rows.groupBy("dedup_key").transformWithState(Suppress(windows, own), "dedup_key string, rule string, finding string, ms long", "Append", "EventTime")
    return out.select("dedup_key", "rule", "finding", F.timestamp_millis("ms").alias("told_at"))


# -- T2, T11, X15: last-known state that expires --------------------------------------------------


class LastKnown(_Timed):
    """State of one aircraft: its newest row.  It goes when the watermark, or with ``ttl_ms`` the clock, has passed its retention."""

    def __init__(self, keep_ms: int, ttl_ms: int | None = None):
        self.keep_ms, self.ttl_ms = keep_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("last", "seen_ms bigint, row string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get() if self.state.exists() else None
        held = stored
        for pdf in rows:
            for seen, row in zip(pdf["seen_ms"].tolist(), pdf["row"].tolist()):
                # strictly newer: a tie keeps the stored row, and of one batch the row whose text is smallest
                if held is None or seen > held[0] or held is not stored and seen == held[0] and row < held[1]:
                    held = (int(seen), row)
        if held is not stored:
            self.state.update(held)
            if self.ttl_ms is None:
                self.set_timer(held[0] + self.keep_ms)
        yield pd.DataFrame([(key[0], *held, False)] if held is not stored else [], columns=["icao24", "ms", "row", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], *held, True)], columns=["icao24", "ms", "row", "gone"])


def stream_last_known(positions: DataFrame, hours: float = 3, delay: str = "0 seconds", clock: bool = False) -> DataFrame:
    """Changes of the last-known state: ``icao24, last_seen_at, row`` (JSON), ``gone`` where it expired.

    A row goes ``hours`` after its own time by the watermark, as ``stores.prune_current`` has it.  With ``clock``
    the state store lets it go ``hours`` after it came, without a word; such a stream never runs out of empty
    batches, so an ``availableNow`` run needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    ``read_state`` shows what is left.
    """
    seen = sc.event_time("ts_position", "ts_polled")
    rows = positions.withWatermark("ts_polled", delay).select("icao24", "ts_polled", _ms(seen).alias("seen_ms"), F.to_json(F.struct(*positions.columns)).alias("row"))
    keep = int(hours * 60 * MINUTE)
    processor, mode = (LastKnown(keep, keep), "ProcessingTime") if clock else (LastKnown(keep), "EventTime")
    out = rows.groupBy("icao24").transformWithStateInPandas(processor, "icao24 string, ms long, row string, gone boolean", "Update", mode)
    return out.select("icao24", F.timestamp_millis("ms").alias("last_seen_at"), "row", "gone")


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """``key, value`` of one state variable as a table, as of the newest batch."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load().select("key", "value")
