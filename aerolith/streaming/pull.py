"""Changed records of a feed of Parquet files as a stream that resumes where it stopped."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FIELDS = "salesforce_id string, external_id string, crm_status string, priority string, summary string, resolved_at timestamp, record_type string, modstamp timestamp"
KEY = ["salesforce_id", "external_id", "record_type", "modstamp"]
MICROS = pa.timestamp("us")


def _dataset(path: str) -> ds.Dataset:
    scheme, found, rest = path.partition(":")
    return ds.dataset("/" + rest.lstrip("/") if found and scheme == "file" else path, format="parquet")


def _newest(fragment: ds.ParquetFileFragment) -> int | None:
    """Newest change in a file by its footer, in microseconds; None if the footer doesn't say."""
    groups = [fragment.metadata.row_group(i) for i in range(fragment.metadata.num_row_groups)]
    columns = [g.column(i) for g in groups for i in range(g.num_columns) if g.column(i).path_in_schema == "modstamp"]
    if any(c.physical_type == "INT96" or c.statistics is None or not c.statistics.has_min_max for c in columns):
        return None
    return max((_micros(c.statistics.max) for c in columns), default=-1)


def _micros(t: dt.datetime) -> int:
    return (t.replace(tzinfo=t.tzinfo or dt.timezone.utc) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def _keys(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """Time in microseconds and id of each record."""
    at = pc.cast(batch.column("modstamp"), MICROS, safe=False) if batch.schema.field("modstamp").type.tz is None else pc.cast(batch.column("modstamp"), pa.timestamp("us", "UTC"), safe=False)
    return at.cast(pa.int64()), pc.coalesce(batch.column("salesforce_id"), batch.column("external_id"), pa.scalar(""))


class _Files(InputPartition):
    def __init__(self, name: str, start: tuple[int, str], end: tuple[int, str]):
        self.name, self.start, self.end = name, start, end


class _Changes(DataSourceStreamReader):
    def __init__(self, path: str, since: int):
        self.path, self.since = path, since

    def initialOffset(self) -> dict:
        return {"modstamp": self.since, "id": ""}

    def latestOffset(self) -> dict:
        """The newest fleet record's time and id; files that by their footers are older than it aren't opened."""
        best = (self.since, "")
        files = [(_newest(f), f) for f in _dataset(self.path).get_fragments()]
        for top, f in sorted(files, key=lambda x: (x[0] is not None, -(x[0] or 0))):
            if top is not None and top < best[0]:
                break
            for batch in f.to_batches(columns=KEY, filter=ds.field("record_type") == "fleet"):
                if batch.num_rows and (at := _keys(batch))[0].null_count < batch.num_rows:
                    last = pc.max(at[0])
                    best = max(best, (last.as_py(), pc.max(at[1].filter(pc.equal(at[0], last))).as_py()))
        return {"modstamp": best[0], "id": best[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """One task a file that may hold changes after ``start``."""
        a, b = ((o["modstamp"], o["id"]) for o in (start, end))
        files = [(f.path, _newest(f)) for f in _dataset(self.path).get_fragments()]
        return [_Files(name, a, b) for name, top in files if top is None or top >= a[0]]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        times = {"resolved_at", "modstamp"}
        types = [pa.timestamp("us", "UTC") if n in times else pa.string() for n in names]
        folder = _dataset(self.path)
        one = next(f for f in folder.get_fragments() if f.path == partition.name)
        for batch in one.to_batches(columns=names, filter=ds.field("record_type") == "fleet"):
            at, key = _keys(batch)

            def after(o: tuple[int, str]) -> pa.Array:
                return pc.or_(pc.greater(at, o[0]), pc.and_(pc.equal(at, o[0]), pc.greater(key, o[1])))

            batch = batch.filter(pc.and_(after(partition.start), pc.invert(after(partition.end))))
            if batch.num_rows:
                columns = [pc.cast(batch.column(n), MICROS, safe=False).cast(t) if n in times and batch.column(n).type.tz is None else batch.column(n).cast(t, safe=False) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays(columns, names)


class ChangeFeed(DataSource):
    """Options: ``path`` of the feed and ``since``, microseconds at which a first run begins."""

    @classmethod
    def name(cls) -> str:
        return "crm_changes"

    def schema(self) -> str:
        return FIELDS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Changes(self.options["path"], int(self.options["since"]))


def stream_changes(spark: SparkSession, path: str, now: dt.datetime, lookback: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """Fleet records of the feed in ``path``, each once, as a stream.

    Its offset is the (modstamp, id) of the newest record taken, kept in the stream's checkpoint: a restart resumes there,
    a poll without new records moves nothing and runs no batch, and the first run begins ``lookback`` before ``now``.
    A record without a modstamp is never taken; one that arrives later than others with a newer (modstamp, id) isn't either.
    The driver reads footers and the newest files' keys; records are read by one task a file.
    """
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("crm_changes").option("path", path).option("since", str(_micros(now - lookback))).load()
