"""Means that are rounded at a tie are those of the SQL on one thread, however the rows are dealt out."""

import itertools

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagelattice.plans import catalog


def answers(name, path, view):
    c = duckdb.connect()
    c.execute("set threads = 1")
    c.execute(f"create view {view} as select * from '{path}'")
    found = c.execute(catalog.oracle_sql()[name])
    return [d[0] for d in found.description], sorted(found.fetchall())


def same(spark, name, folder, path, view):
    columns, want = answers(name, path, view)
    assert sorted(map(tuple, catalog.queries()[name](spark, str(folder)).select(*columns).collect())) == want


@pytest.mark.parametrize("name", ["agg4", "agg7"])
def test_region_spread_follows_the_raster(spark, tmp_path, name):
    rng = np.random.default_rng(4)
    images = np.full((40, 64 * 64), 0.4, np.float32)  # 20 or 160 dark pixels, so that many means lie between two millionths
    for k, a in enumerate(images):
        a[rng.choice(a.size, 160 if k % 2 else 20, replace=False)] = -0.4
    rows = images.reshape(-1, 64)
    t = pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows), pa.list_(pa.float32())), "label": np.zeros(len(rows), np.int32)})
    pq.write_table(t, tmp_path / "rising.parquet")
    pq.write_table(t.take(np.arange(len(rows))[::-1]), tmp_path / "embeddings.parquet")
    same(spark, name, tmp_path, tmp_path / "rising.parquet", "embeddings")


def test_mean_slope_follows_the_rows(spark, tmp_path):
    sets = ([(182, 250), (33, -12), (-51, 160), (73, 100)], [(-133, -70), (-106, -64), (-98, 84), (-136, -150)])
    orders = [p for s in sets for p in itertools.permutations(s)]
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(4):  # later files are larger: Spark reads the largest first
        part = [(500 * i, 262 - p[k][1], (266 - p[k][0]) * 143 % 500) for i, p in enumerate(orders, 1)] + [(500 * i, 1, 1) for i in range(1000, 1000 + 500 * k)]
        o, p, s = (np.array(x) for x in zip(*part))
        t = pa.table({"l_orderkey": o, "l_partkey": p, "l_suppkey": s, "l_linenumber": np.full(len(o), 2, np.int32), "l_quantity": np.full(len(o), 4.0)})
        pq.write_table(t, tmp_path / "lineitem.parquet" / f"{k}.parquet")
    same(spark, "geo11", tmp_path, f"{tmp_path}/lineitem.parquet/*.parquet", "lineitem")
