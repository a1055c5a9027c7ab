"""Takeoff and landing edges with state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "icao24 string, kind string, at timestamp, flight_id string"


class Edges(StatefulProcessor):
    """State of one aircraft: on ground or not, time of its last fix, key of its open flight.

    With ``ttl_s`` the state store forgets an aircraft that long after its last fix came (W8).
    """

    def __init__(self, max_gap_s: int | None = None, ttl_s: float | None = None):
        self.max_gap_s, self.ttl_s = max_gap_s, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("aircraft", "on_ground boolean, seen_s bigint, flight_id string", None if self.ttl_s is None else int(self.ttl_s * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # what counts of a row is little: its time, its place among ties and one flag
        fixes: list[tuple] = []
        for pdf in rows:
            fixes += zip(pdf["ts_polled"].tolist(), pdf["tie"].tolist(), pdf["on_ground"].tolist())
        fixes.sort(key=lambda f: f[:2])
        held = self.state.get() if self.state.exists() else None
        was, seen, flight = held if held else (None, None, None)
        out = []
        for ts, _, ground in fixes:
            second = int(ts.timestamp())
            if seen is not None and (second < seen or self.max_gap_s is not None and second - seen > self.max_gap_s):
                if second < seen:
                    continue  # late: what is known is newer
                was, flight = None, None
            if was and not ground:
                flight = f"{key[0]}-{second}"
                out.append((key[0], "takeoff", ts, flight))
            elif was is False and ground:
                if flight is not None:
                    out.append((key[0], "landing", ts, flight))
                flight = None
            was, seen = bool(ground), second
        self.state.update((was, seen, flight))
        yield pd.DataFrame(out, columns=["icao24", "kind", "at", "flight_id"])

    def close(self) -> None:
        pass


def stream_lifecycle(positions: DataFrame, max_gap_s: int | None = None, tie: str | None = None, ttl_s: float | None = None) -> DataFrame:
    """Edges of a positions stream; fixes of one time come in the order of ``tie``.  Needs the RocksDB state store provider."""
    rows = positions.select("icao24", "ts_polled", "on_ground", (F.col(tie) if tie else F.lit(0)).cast("long").alias("tie"))
    return rows.groupBy("icao24").transformWithStateInPandas(Edges(max_gap_s, ttl_s), OUTPUT, "Append", "None" if ttl_s is None else "ProcessingTime")
