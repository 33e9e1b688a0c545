"""The operators that SQL can express give the rows that DuckDB gives."""

import os

import pytest

from pagelattice.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not there")
@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
