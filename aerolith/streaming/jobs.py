"""Streams over the snapshot and log folders (T1, T2, T5 to T10); those with timers are in ``keyed``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import scalars as sc
from ..operators import kpi, rules, serving, stores
from ..plans.ingest import to_current, to_positions
from ..sources import lake
from ..sources.readers import decode_state_vectors
from ..sources.upserts import overwrite_by_key, upsert_positions
from .tables import VersionedTable


def stream_ingest(spark: SparkSession, folder: str, prefixes: DataFrame, sites: DataFrame, lines: bool = False) -> DataFrame:
    """New snapshot files as positions (T1); write it with ``write_hours``.  A file is one snapshot, or with ``lines`` has one a line."""
    raw = spark.readStream.schema("value string").option("wholetext", str(not lines).lower()).text(folder)
    return to_positions(decode_state_vectors(raw), prefixes, sites)


def write_hours(positions: DataFrame, root: str, checkpoint: str, files: int = 8) -> DataStreamWriter:
    """Positions into the lake's hours; of one batch an hour has at most ``files`` files."""
    rows = positions.withColumns(lake.parts("ts_polled", lake.HOUR))
    rows = rows.repartition(*lake.HOUR, F.pmod(F.xxhash64("icao24"), F.lit(files)))
    return rows.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).partitionBy(*lake.HOUR)


def _each_batch(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def stream_current(positions: DataFrame, table: VersionedTable, checkpoint: str) -> DataStreamWriter:
    """Last-known state; a row that is not newer than the stored one changes nothing."""

    def step(batch: DataFrame, n: int) -> None:
        table.upsert(to_current(batch), n, ["icao24"], upsert_positions)

    return _each_batch(positions, checkpoint, step)


def gaps(current: DataFrame, now: Column, low: float = 14, high: float = 30) -> DataFrame:
    """Aircraft of a table that are silent for ``low`` to ``high`` minutes; ``keyed.stream_silence`` is the stream of them (T4)."""
    return current.withColumn("gap_minutes", sc.minutes_between(now, "last_seen_at")).filter(F.col("gap_minutes").between(low, high))


def stream_rules(positions: DataFrame, history: VersionedTable, out: VersionedTable, context: Callable[[DataFrame], rules.Context], cases: Callable[[], DataFrame], checkpoint: str, minutes: int = 30) -> DataStreamWriter:
    """All rules over the sliding window of the last ``minutes`` at each batch, without open cases.

    The window is the only state and is trimmed each time, so it is bounded by its length.
    """

    def step(batch: DataFrame, n: int) -> None:
        if batch.isEmpty():
            return
        before = history.read(before=n)
        rows = batch if before is None else before.unionByName(batch)
        newest = rows.agg(F.max("ts_polled")).first()[0]
        rows = rows.filter(F.col("ts_polled") >= F.lit(newest) - F.expr(f"interval {int(minutes)} minutes"))
        history.write(rows, n)
        out.write(rules.detect(context(history.read()), cases(), F.lit(newest)), n)

    return _each_batch(positions, checkpoint, step)


def hold_windows(positions: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Fixes, span and sectors per aircraft in 30-minute windows every 5 minutes (T5), for streams and tables."""
    from ..functions.geo import heading_sector

    df = positions.withWatermark("ts_polled", watermark) if positions.isStreaming else positions
    df = df.groupBy(F.window("ts_polled", "30 minutes", "5 minutes").alias("w"), "icao24")
    sectors = F.size(F.collect_set(heading_sector("heading_deg")))  # eight at most
    return df.agg(F.count("*").alias("n"), sc.minutes_between(F.max("ts_polled"), F.min("ts_polled")).alias("minutes"), sectors.alias("sectors")).select(F.col("w.start").alias("window_start"), "icao24", "n", "minutes", "sectors")


def stream_dedup(anomalies: DataFrame, rule: rules.Rule, ts: str = "detected_at") -> DataFrame:
    """Findings of one rule, each key once within the rule's window.

    A key is free again one batch after the watermark has passed its window.  Cases that are resolved
    meanwhile free no key here; ``keyed.stream_suppress`` reads their changes too.
    """
    own = anomalies.filter(F.col("rule") == rule.case_type)
    return own.withWatermark(ts, f"{rule.window_minutes} minutes").dropDuplicatesWithinWatermark(["dedup_key"])


def stream_case_mirror(cases: DataFrame, table: VersionedTable, checkpoint: str) -> DataStreamWriter:
    """Case objects by id; the checkpoint moves only after the batch is written."""

    def step(batch: DataFrame, n: int) -> None:
        from ..operators.windows import latest_per_key

        new = stores.mirror_cases(latest_per_key(batch, ["case_id"], "updated_at"))
        table.upsert(new, n, ["case_id"], lambda old, rows: rows if old is None else overwrite_by_key(old, rows, ["case_id"]))

    return _each_batch(cases, checkpoint, step)


def pull_changes(crm: DataFrame, watermark: Column, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Changed records, and the new watermark as one row; it stays where nothing came."""
    page = serving.crm_changes(crm, watermark, limit)
    return page, page.agg(F.coalesce(F.max("modstamp"), F.first(watermark)).alias("watermark"))


def first_watermark(now: Column) -> Column:
    return now - F.expr("interval 1 hour")


def stream_kpis(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Request KPIs in tumbling windows; later rows than the watermark are not counted."""
    return kpi.request_kpis(log.withWatermark("ts", watermark))


def expire(current: DataFrame, now: Column, hours: int = 3) -> DataFrame:
    """Last-known state of a table without what is older than its retention; ``keyed.stream_last_known`` is the stream."""
    return stores.prune_current(current, now, hours)
