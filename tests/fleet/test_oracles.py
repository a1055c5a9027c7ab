"""Every fleet query against DuckDB; the four that give JSON texts must give some."""

import duckdb
import pytest

from aerolith import catalog

from ..conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


def plain(rows):
    def value(x):
        return round(x, 5) if isinstance(x, float) else x

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_small, duck, name):
    df = catalog.QUERIES[name](spark, sf_small)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name not in catalog.ORACLES:  # JSON texts; their members have entries with SQL
        assert name in ("s25_export_trails", "s26_export_cases", "s26_export_aircraft", "s28_export_crm") and got
        return
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == plain([r[i] for i in order] for r in want.fetchall())
