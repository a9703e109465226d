"""Every sample query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from millrace.plans import feeds, oracles, samples, stream_oracles, streams

QUERIES, ORACLES = samples.QUERIES | streams.QUERIES | feeds.QUERIES, oracles.ORACLES | stream_oracles.STREAM_ORACLES | feeds.ORACLE_SQL

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, ROOT)
    assert sorted(got.columns) == columns
    rows = want.select(",".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))
