"""The change feed as a stream: first lookback, resumption, empty polls, ties."""

import datetime as dt

from aerolith.streaming import pull

NOW = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)


def add(spark, folder, *rows):
    """(id, minutes after now or None, type) records as one more file."""
    at = lambda m: None if m is None else NOW + dt.timedelta(minutes=m)
    data = [(i if i != "x" else None, "ext", "New", None, None, None, kind, at(m)) for i, m, kind in rows]
    spark.createDataFrame(data, pull.FIELDS).coalesce(1).write.mode("append").parquet(folder)


def test_pull_resumes(spark, tmp_path):
    folder, seen, batches = str(tmp_path / "feed"), [], []

    def poll():
        seen.clear(), batches.clear()

        def step(df, n):
            batches.append(n)
            seen.extend((r.salesforce_id or r.external_id, r.modstamp) for r in df.collect())

        stream = pull.stream_changes(spark, folder, NOW)
        stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(i for i, _ in seen)

    add(spark, folder, ("old", -90, "fleet"), ("a", -59, "fleet"), ("b", -10, "fleet"), ("other", -5, "else"), ("never", None, "fleet"), ("x", -20, "fleet"))
    assert poll() == ["a", "b", "ext"]
    assert poll() == [] and batches == []  # nothing new: no batch, the offset stays
    add(spark, folder, ("a0", -10, "fleet"), ("c", -10, "fleet"), ("d", 3, "fleet"))  # a0 is before b, at the same time
    add(spark, folder, ("e", 3, "fleet"), ("f", 2, "fleet"))
    assert poll() == ["c", "d", "e", "f"]
    add(spark, folder, ("later", 9, "else"))
    assert poll() == []
    add(spark, folder, ("g", 4, "fleet"))
    assert poll() == ["g"]


def test_footers_leave_old_files_shut(spark, tmp_path):
    folder = str(tmp_path / "feed")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")  # the other kind has no bounds
    add(spark, folder, ("a", -500, "fleet"))
    add(spark, folder, ("b", 1, "fleet"))
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    reader = pull._Changes(folder, 0)
    end = reader.latestOffset()
    assert end == {"modstamp": pull._micros(NOW + dt.timedelta(minutes=1)), "id": "b"}
    assert len(reader.partitions(reader.initialOffset(), end)) == 2
    assert len(reader.partitions({"modstamp": pull._micros(NOW), "id": ""}, end)) == 1
