"""Operators that SQL can express against DuckDB over all documents of the smallest table."""

import duckdb
import pytest

from aerolith.llm import catalog

from ..conftest import DATA


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_same_rows_as_sql(spark, sf_small, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf_small)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want.fetchall())
