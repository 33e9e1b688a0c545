"""Greedy merges: order, partitions and fixed points."""

import numpy as np

from pagelattice.operators import greedy
from pagelattice.plans import greedy_queries


def test_partitions_do_not_matter(spark):
    rows = [(i % 7, i, (i * 37) % 90, (i * 53) % 90, 10 + i % 13, 8 + i % 9) for i in range(140)]
    df = spark.createDataFrame(rows, "img long, id long, x long, y long, w long, h long")
    one, many = (sorted(map(tuple, greedy.merged_boxes(df.repartition(n)).collect())) for n in (1, 9))
    assert one == many and 7 <= len(one) <= len(rows)


def test_steady_bands_drop_the_first_jump_each_time(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate([10, 12, 60, 15, 40, 30, 200, 31])], "doc long, band long, min_x long")
    got = sorted(map(tuple, greedy.steady_bands(df).collect()))
    xs = [10, 12, 60, 15, 40, 30, 200, 31]
    want = list(enumerate(xs))
    while True:
        bad = next((k for k in range(1, len(want)) if not -100 <= want[k][1] - want[k - 1][1] <= 20), None)
        if bad is None:
            break
        del want[bad]
    assert [(b, x) for _, b, x in got] == want


def test_distinct_lines_keep_the_best(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 10.0, 5), (1, 2, 0.52, 12.0, 9), (1, 3, 1.5, 10.0, 1), (2, 1, 0.0, 0.0, 1)], "img long, id long, angle double, rho double, score long")
    assert sorted(map(tuple, greedy.distinct_lines(df).collect())) == [(1, 2), (1, 3), (2, 1)]


def test_segment_blocks(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 100, 0), (1, 2, 10, 20, 90, 20), (1, 3, 200, 25, 300, 25), (1, 4, 0, 300, 100, 300)], "img long, id long, x1 long, y1 long, x2 long, y2 long")
    assert sorted((r.id, r.block) for r in greedy.segment_blocks(df).collect()) == [(1, 0), (2, 0), (3, 1), (4, 2)]
    assert greedy.slopes(df.where("img = 9")).count() == 0


def test_kernels_see_every_pixel_of_the_table():
    table = np.random.default_rng(5).integers(0, 256, (64, 64)).astype(np.uint8)
    seen = greedy_queries._tiny(np.kron(table, np.ones((3, 3), np.uint8)))
    assert (seen == table).all()
    assert greedy_queries._trimap(seen).shape == (64, 64)
    assert (np.unique(greedy_queries._trimap(seen)) == [0, 128, 255]).all()
