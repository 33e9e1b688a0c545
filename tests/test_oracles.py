"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pagelattice.plans import catalog

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    kinds = {d[0]: str(d[1]) for d in answer.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    at = [names.index(c) for c in columns]
    assert mine == sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=repr)


def test_flagship_and_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["img", "blobs", "pixels"]
    assert catalog.queries()["flagship"](spark, DATA).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
