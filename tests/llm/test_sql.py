"""Each operator's SQL, where there is one, against its query on the smallest tables."""

import os

import pytest

from vecloom.llm import entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    want, got = con.execute(entry.ORACLES[name]).df(), entry.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in found)
    assert rows(got.select(*columns).collect()) == rows(want[columns].itertuples(index=False))
