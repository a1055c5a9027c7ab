"""The partitioned Parquet lake: positions by hour, flights by landed day."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FLIGHTS_ARCHIVE, POSITIONS, conform

HOUR, DAY = ("year", "month", "day", "hour"), ("year", "month", "day")


def parts(ts: str, names: tuple[str, ...]) -> dict:
    """Partition values in UTC, whatever the session's zone."""
    days = F.expr(f"date_add(date'1970-01-01', cast(floor(unix_seconds({ts}) / 86400) as int))")
    hour = F.expr(f"cast(pmod(floor(unix_seconds({ts}) / 3600), 24) as int)")
    return {n: hour if n == "hour" else getattr(F, {"day": "dayofmonth"}.get(n, n))(days) for n in names}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_positions(df: DataFrame, root: str, polled_at: dt.datetime) -> None:
    """Append a snapshot: one poll time, UTC hour partitions; an empty one is refused."""
    df = conform(df.withColumn("ts_polled", F.lit(polled_at).cast("timestamp")), POSITIONS)
    if df.isEmpty():
        raise ValueError("an empty snapshot is not written")
    df.withColumns(parts("ts_polled", HOUR)).write.mode("append").option("compression", "zstd").partitionBy(*HOUR).parquet(root)


def scan_positions(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots; a lake that does not exist yet is a typed empty frame."""
    if not _exists(spark, root):
        return spark.createDataFrame([], POSITIONS)
    return spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POSITIONS) + ", year int, month int, day int, hour int").parquet(root)


def hour_of_partition():
    return F.make_timestamp("year", "month", "day", "hour", F.lit(0), F.lit(0), F.lit("UTC"))


def between_times(df: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rows polled in [start, end]; hours outside are pruned by their partition values."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return df.filter((hour_of_partition() > low - F.expr("interval 1 hour")) & (hour_of_partition() <= high) & F.col("ts_polled").between(low, high))


def cluster_hours(spark: SparkSession, root: str, out: str, start: dt.datetime, end: dt.datetime) -> None:
    """Write the hours of [start, end) anew below ``out``, ordered by aircraft and time.

    Snapshots hold every aircraft, so nothing in a lake of them can be skipped for one aircraft.  Here an aircraft's fixes
    of an hour lie together: page bounds and Bloom filters of the id leave a few pages of each hour to be read.  Ranges
    go by time too, so one aircraft may fill many files.  An hour that is written again replaces itself, and the snapshots stay.
    """
    order = (*HOUR, "icao24", "ts_polled")
    df = between_times(scan_positions(spark, root), start, end).filter(F.col("ts_polled") < F.lit(end).cast("timestamp"))
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    write = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    write.option("parquet.bloom.filter.enabled#icao24", "true").option("parquet.page.row.count.limit", 2_000).partitionBy(*HOUR).parquet(out)


def recent_positions(spark: SparkSession, root: str, minutes: int, now: dt.datetime) -> DataFrame:
    """Positions of the last ``minutes`` up to ``now``."""
    df = scan_positions(spark, root)
    return between_times(df, now - dt.timedelta(minutes=minutes), now).drop(*HOUR) if "hour" in df.columns else df


#: Partition below the day: the run that wrote the rows, as milliseconds of its ``archived_at``.
RUN = "run"


def write_flights_archive(df: DataFrame, root: str) -> None:
    """Completed flights by landed day and run; a null in a required column fails the write.

    A run that is started again replaces its own partitions and no others, so it leaves each row once.
    """
    df = conform(df, FLIGHTS_ARCHIVE)
    must = [f.name for f in FLIGHTS_ARCHIVE if not f.nullable]
    broken = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in must))
    df = df.withColumn("flight_id", F.when(broken, F.raise_error(F.lit(f"null in one of {', '.join(must)}")).cast("string")).otherwise(F.col("flight_id")))
    df = df.withColumns(parts("landed_at", DAY)).withColumn(RUN, F.unix_millis("archived_at"))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*DAY, RUN).parquet(root)


def day_of_partition():
    return F.make_date("year", "month", "day")


def read_flights_archive(spark: SparkSession, root: str, days: int | None = None, now: dt.datetime | None = None, columns: list[str] | None = None, run_at: dt.datetime | None = None) -> DataFrame:
    """Archived flights, optionally of the last ``days`` UTC day partitions and some columns.

    A flight that several runs have archived, because one broke off before it could delete, is read once, as the
    newest run has it.  ``run_at`` reads the rows of one run only.
    """
    if not _exists(spark, root):
        df = spark.createDataFrame([], FLIGHTS_ARCHIVE)
        return df if columns is None else df.select(*columns)
    df = spark.read.parquet(root)
    if days is not None:
        df = df.filter(day_of_partition() >= F.lit((now.astimezone(dt.timezone.utc) - dt.timedelta(days=days)).date()))
    if run_at is not None:
        df = df.filter(F.col(RUN) == F.unix_millis(F.lit(run_at).cast("timestamp")))
    df = df.drop(*DAY, RUN)
    df = df if columns is None else df.select(*dict.fromkeys([*columns, "flight_id", "archived_at"]))
    if run_at is None:
        rest = [c for c in df.columns if c != "flight_id"]
        df = df.groupBy("flight_id").agg(F.max_by(F.struct(*rest), "archived_at").alias("_r")).select("flight_id", *(F.col(f"_r.{c}").alias(c) for c in rest))
    else:
        df = df.dropDuplicates(["flight_id"])
    return df.select(*(columns or FLIGHTS_ARCHIVE.fieldNames()))


def read_archive_files(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """The named files that exist."""
    there = [p for p in paths if _exists(spark, p)]
    df = spark.read.parquet(*there) if there else spark.createDataFrame([], FLIGHTS_ARCHIVE)
    return df if columns is None else df.select(*columns)


def archive_count(spark: SparkSession, root: str) -> int:
    return read_flights_archive(spark, root, columns=["flight_id"]).count()


def archive_count_at(spark: SparkSession, root: str, archived_at: dt.datetime) -> int:
    return read_flights_archive(spark, root, columns=["flight_id"], run_at=archived_at).count()


def stored_rows(spark: SparkSession, root: str) -> DataFrame:
    """``year, month, day, run, n``: rows that each partition stores, from the footers of its files alone.

    A flight of several runs counts in each; ``archive_count`` reads ids and counts it once.  Only the second reader of
    Parquet answers counts from footers, which is a setting of a session, so the frame belongs to one of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    if not _exists(spark, root):
        return own.createDataFrame([], "year int, month int, day int, run bigint, n bigint")
    return own.read.parquet(root).groupBy(*DAY, RUN).agg(F.count("*").alias("n"))


def oldest_partition(spark: SparkSession, root: str) -> dt.date | None:
    """Oldest landed day that the archive holds, from footers."""
    return stored_rows(spark, root).agg(F.min(day_of_partition())).first()[0]


def purge_partitions(spark: SparkSession, root: str, cutoff: dt.date) -> list[dt.date]:
    """Delete day partitions before ``cutoff`` as a whole and return their dates."""
    if not _exists(spark, root):
        return []
    days = spark.read.parquet(root).select(*DAY).filter(day_of_partition() < F.lit(cutoff)).distinct().orderBy(*DAY).collect()
    for d in days:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/year={d['year']}/month={d['month']}/day={d['day']}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    spark.catalog.refreshByPath(root)
    return [dt.date(d["year"], d["month"], d["day"]) for d in days]
