"""The SQL of this subpackage against its queries, and that every query is there."""

import os

import duckdb
import pytest

import __spark_entry__
from millrace.llm import queries

ROOT = "/root/testdata/sf0.001"


def test_names():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, ROOT)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.select(",".join(columns)).fetchall()))
