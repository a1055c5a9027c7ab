"""Tables in which sites come again, aircraft are many and windows are full, against DuckDB."""

import shutil

import duckdb
import pytest

from aerolith import catalog

from ..conftest import DATA
from .test_oracles import TABLES, plain


@pytest.fixture
def tables(tmp_path):
    """A copy of the smallest tables in which some are replaced by SQL over themselves."""

    def put(**replaced):
        for t in TABLES:
            source = f"{DATA}/sf0.001/{t}.parquet"
            if t in replaced:
                duckdb.sql(f"COPY (WITH {t} AS (SELECT * FROM '{source}') {replaced[t]}) TO '{tmp_path}/{t}.parquet'")
            else:
                shutil.copy(source, f"{tmp_path}/{t}.parquet")
        return str(tmp_path)

    return put


def agrees(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.execute(catalog.ORACLES[name])
    got = plain(df.select(*(d[0] for d in want.description)).collect())
    assert got == plain(want.fetchall())
    return got


#: Site numbers have three digits, so suppliers 1001 to 1010 are all at K100.
REPEATED = "SELECT i AS s_suppkey, concat('Supplier#', i) AS s_name, CAST(i % 25 AS INT) AS s_nationkey, CAST(i * 37 % 9000 AS DOUBLE) AS s_acctbal FROM (SELECT unnest(range(95, 131)) AS i UNION ALL SELECT unnest(range(1000, 1300)))"


def test_sites_that_come_again_are_in_later_watchlists(spark, tables):
    assert len(agrees(spark, tables(supplier=REPEATED), "s7_watchlist")) > 100


def test_an_airport_that_several_watchlists_hold_is_read_once(spark, tables):
    assert len(agrees(spark, tables(supplier=REPEATED), "s5_airports")) > 100


def test_upserted_airports_are_told_for_each_row_of_both_sides(spark, tables):
    assert len(agrees(spark, tables(supplier=REPEATED), "s22_upsert_airports")) > 100


def test_a_station_that_reports_again_meets_one_forecast(spark, tables):
    assert len(agrees(spark, tables(supplier=REPEATED), "j8_conditions")) == 336


def test_documents_are_as_many_as_the_rows_ask_for(spark, tmp_path):
    from aerolith.queries_feeds import _documents

    path = _documents(spark.range(2_500).selectExpr("id", "cast(null as string) as none"), str(tmp_path / "docs"), size=500)
    docs = spark.read.text(path, wholetext=True).selectExpr("size(from_json(value, 'array<struct<id:long>>')) as n").collect()
    assert len(docs) == 6 and sum(d["n"] for d in docs) == 2_500 and max(d["n"] for d in docs) <= 500
    assert [p for p in (tmp_path / "docs").iterdir() if p.is_dir()] == []


def test_p95_of_many_latencies_is_exact(spark, tables, tmp_path):
    many = "SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i % 1500 AS user_id, CASE WHEN i % 3 = 0 THEN 'view' ELSE 'error' END AS event_type, i * 7919 % 120011 / 64.0 AS value, '{}' AS props FROM (SELECT unnest(range(120011)) AS i)"
    folder = tables(events=many.replace("/ 64.0", "/ CAST(64 AS DOUBLE)"))
    assert len(agrees(spark, folder, "a29_latency_p95")) == 2


FLEET = "SELECT i AS event_id, TIMESTAMP '2024-01-30' + to_seconds(i % 600) AS ts, i * 25 + 1 AS user_id, 'view' AS event_type, 1.0 AS value, '{}' AS props FROM (SELECT unnest(range(1200)) AS i)"
OWNERS = "SELECT i AS c_custkey, concat('Customer#', i) AS c_name, CAST(i % 25 AS INT) AS c_nationkey, 1.0 AS c_acctbal, 'FURNITURE' AS c_mktsegment FROM (SELECT unnest(range(30000)) AS i)"


def test_site_flow_holds_every_aircraft(spark, tables):
    assert len(agrees(spark, tables(events=FLEET, customer=OWNERS), "l5_site_flow")) == 900


def test_snapshots_may_come_one_a_line(spark, tmp_path):
    import json

    from aerolith.streaming import jobs

    vector = ["abc123", "X", "US", 1714565000, 1714565000, -99.9, 40.1, 1000.0, False, 100.0, 90.0, 0.0, None, None, None, False, 0]
    (tmp_path / "in.json").write_text("".join(json.dumps({"time": 1714565000 + 300 * i, "states": [vector]}) + "\n" for i in range(3)))
    prefixes = spark.createDataFrame([("ff",)], "prefix string")
    sites = spark.createDataFrame([("KAAA", 40.0, -100.0, ["west"])], "icao string, lat double, lon double, customer_regions array<string>")
    stream = jobs.stream_ingest(spark, str(tmp_path / "in*.json"), prefixes, sites, lines=True)
    jobs.write_hours(stream, str(tmp_path / "lake"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "lake")).count() == 3


def test_a_bucket_of_a_version_is_one_file(spark, tmp_path):
    from aerolith.sources.upserts import overwrite_by_key
    from aerolith.streaming.tables import VersionedTable

    table = VersionedTable(spark, str(tmp_path / "t"), buckets=4)
    merge = lambda old, new: new if old is None else overwrite_by_key(old, new, ["id"])
    for n in range(2):
        table.upsert(spark.range(1_000).repartition(7).selectExpr("id", f"{n} as v"), n, ["id"], merge)
        assert len(list(tmp_path.glob(f"t/v-{n:012d}/bucket=*/*.parquet"))) == 4
    assert table.read().where("v = 1").count() == table.read().count() == 1_000


def test_suppression_writes_only_what_changes():
    from types import SimpleNamespace

    from pyspark.sql import Row

    from aerolith.streaming.keyed import Suppress

    done, state = [], {("c1",): (1_000, 60_000)}
    suppress = Suppress({"go_around": 30}, own=False)
    suppress.open = SimpleNamespace(iterator=lambda: iter(state.items()), clear=lambda: done.append("clear"), updateValue=lambda *a: done.append(a), removeKey=lambda k: done.append(k))
    suppress.handle = SimpleNamespace(listTimers=lambda: iter(()), deleteTimer=done.append, registerTimer=done.append)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    finding = Row(ms=2_000, finding="f", case_id=None, created_ms=None, is_open=None, rule="go_around")
    assert list(suppress.handleInputRows(("k",), iter([finding]), now)) == [] and done == []
    resolved = Row(ms=3_000, finding=None, case_id="c1", created_ms=1_000, is_open=False, rule="go_around")
    assert list(suppress.handleInputRows(("k",), iter([resolved]), now)) == [] and done == ["clear", 61_001]
