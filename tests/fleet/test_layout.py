"""Trails of any length, the lake ordered by aircraft, and counts from footers."""

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import functions as F

from aerolith.operators import windows
from aerolith.sources import exports, lake

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, 5, tzinfo=UTC)


def fixes(spark, n):
    """``n`` fixes; aircraft ``hot`` has a third of them."""
    df = spark.range(n)
    ident = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), (F.col("id") % 401).cast("string")))
    fields = {
        "icao24": ident,
        "ts_polled": F.timestamp_seconds(F.lit(int(T0.timestamp())) + F.col("id") % 3500),
        "lat": F.when(F.col("id") % 7 != 0, F.col("id") / 1000),
        "lon": F.col("id") / 500,
        "altitude_ft": F.col("id").cast("int"),
        "speed_kt": F.when(F.col("id") % 5 != 0, (F.col("id") % 400).cast("int")),
    }
    return df.select(*(c.alias(k) for k, c in fields.items()))


def test_pieces_make_the_same_lines(spark, tmp_path):
    df = fixes(spark, 6_000).unionByName(fixes(spark, 30)).unionByName(fixes(spark, 5).withColumn("icao24", F.lit(None).cast("string")))
    pieces = windows.trail_pieces(df, 100)
    sizes = {(r.icao24, r.piece): (r.n, r.n_pieces) for r in pieces.select("icao24", "piece", "n_pieces", F.size("points").alias("n")).collect()}
    assert max(n for n, _ in sizes.values()) == 100 and sizes["hot", 20] == (10, 21)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would become one file
    exports.write_trails(pieces, str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    got = {d["icao24"]: d for d in map(json.loads, text.strip().splitlines())}
    want = [json.loads(r.value) for r in exports.trails_ndjson(windows.trails(df.filter("icao24 is not null"))).collect()]
    assert len(files) > 1 and got == {d["icao24"]: d for d in want}


def test_a_long_trail_fills_many_tasks(spark):
    rows = windows.numbered(fixes(spark, 9_000), ["icao24"], "ts_polled", "lon")
    # the plan never gathers an aircraft: its rows come in ranges of time as well
    held = fixes(spark, 9_000).repartitionByRange(4, "icao24", "ts_polled").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in held) < 3_000
    hot = rows.filter("icao24 = 'hot'").orderBy("ts_polled", "lon").select("n", "n_of_key").collect()
    assert [r.n for r in hot] == list(range(1, 3_001)) and {r.n_of_key for r in hot} == {3_000}


def test_pieces_of_nothing(spark, tmp_path):
    pieces = windows.trail_pieces(fixes(spark, 0))
    assert pieces.count() == 0
    exports.write_trails(pieces, str(tmp_path / "none"))
    assert "".join(f.read_text() for f in Path(tmp_path / "none").glob("part-*")) == ""


def scanned(df):
    """Rows that the scans of an executed frame gave."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        elif node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_trail_reads_a_few_pages_of_the_clustered_lake(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "clustered")
    df = fixes(spark, 120_000).withColumns({"origin_country": F.lit("x"), "on_ground": F.lit(False)})
    lake.conform(df, lake.POSITIONS).withColumns(lake.parts("ts_polled", lake.HOUR)).write.partitionBy(*lake.HOUR).parquet(raw)
    for _ in range(2):  # again replaces itself
        lake.cluster_hours(spark, raw, out, T0, T0 + dt.timedelta(hours=1))
    now = F.lit(T0 + dt.timedelta(hours=1)).cast("timestamp")
    a, b = (windows.trail(lake.scan_positions(spark, p), "a7", 1, now) for p in (raw, out))
    assert scanned(a) > 100_000 and scanned(b) < 10_000
    key = ["ts", "lon"]
    assert a.orderBy(*key).collect() == b.orderBy(*key).collect() and a.count() > 100
    assert lake.scan_positions(spark, out).count() == 120_000


def test_counts_come_from_footers(spark, tmp_path):
    root = str(tmp_path / "archive")
    assert lake.stored_rows(spark, root).count() == 0 and lake.oldest_partition(spark, root) is None
    days = [T0 - dt.timedelta(days=d) for d in (0, 0, 3)]
    rows = [(f"f{i}", "a", T0, at, T0) for i, at in enumerate(days)]
    lake.write_flights_archive(spark.createDataFrame(rows, "flight_id string, icao24 string, takeoff_ts timestamp, landed_at timestamp, archived_at timestamp"), root)
    counts = lake.stored_rows(spark, root)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [year, month, day, run]" in plan
    assert sorted((r.day, r.n) for r in counts.collect()) == [(1, 2), (29, 1)]
    assert lake.oldest_partition(spark, root) == (T0 - dt.timedelta(days=3)).date()
