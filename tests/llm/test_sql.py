"""The training-data queries that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from opinelake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=key)
    assert sorted(got.columns) == sorted(want.columns) and rows == sorted(want.fetchall(), key=key)
