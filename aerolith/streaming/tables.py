"""A table kept as complete Parquet versions, for foreachBatch upserts.

Version ``n`` is the state after micro-batch ``n``; a batch that is run again after a
failure starts from version ``n - 1`` and writes ``n`` anew, so it is idempotent.
A version holds whole buckets of keys: ``upsert`` reads and writes only the buckets
that its batch touches, and a bucket's state is its newest copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, keep: int = 3, buckets: int = 32):
        self.spark, self.root, self.keep, self.buckets = spark, root, keep, buckets

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _path(self, version: int) -> str:
        return f"{self.root}/v-{version:012d}"

    def _names(self, name: str = "") -> list[str]:
        path = self._hadoop(name)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, name: str) -> None:
        path = self._hadoop(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return sorted(int(n[2:]) for n in self._names() if n.startswith("v-") and "_SUCCESS" in self._names(n))

    def _held(self, before: int | None = None) -> dict[int, int]:
        """The newest version of each bucket."""
        out = {}
        for v in self.versions():
            if before is None or v < before:
                out.update((int(n[7:]), v) for n in self._names(f"v-{v:012d}") if n.startswith("bucket="))
        return out

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The newest state, or the newest before a version, of all or some buckets; None if there is none."""
        held = {b: v for b, v in self._held(before).items() if buckets is None or b in buckets}
        return self.spark.read.parquet(*(f"{self.root}/v-{v:012d}/bucket={b}" for b, v in sorted(held.items()))) if held else None

    def _expire(self) -> None:
        """Buckets that no kept version needs any more go, and versions without any."""
        done = self.versions()
        if len(done) <= self.keep:
            return
        held = self._held(before=done[-self.keep] + 1)  # what the oldest version that is kept consists of
        for old in done[: -self.keep]:
            buckets = [n for n in self._names(f"v-{old:012d}") if n.startswith("bucket=")]
            stale = [n for n in buckets if held[int(n[7:])] != old]
            for name in stale if len(stale) < len(buckets) else [""]:
                self._delete(f"v-{old:012d}/{name}".rstrip("/"))

    def write(self, df: DataFrame, version: int) -> None:
        """The whole state, as one bucket, which is there even if it is empty."""
        name = f"v-{version:012d}"
        self._delete(name)
        df.write.parquet(f"{self.root}/{name}/bucket=0")
        path = self._hadoop(f"{name}/_SUCCESS")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path).close()
        self._expire()

    def upsert(self, batch: DataFrame, version: int, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """State of the batch's buckets after ``merge(state, batch)``; the other buckets are not read."""
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        batch = batch.persist()  # it is read for its buckets and by the merge; what memory lacks goes to disk
        try:
            touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
            state = merge(self.read(version, touched), batch).withColumn("bucket", bucket)
            # a bucket is one task and one file, not one of every task
            state.repartitionById(self.buckets, F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(self._path(version))
        finally:
            batch.unpersist()
        self._expire()
