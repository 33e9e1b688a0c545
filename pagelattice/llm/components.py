"""Connected components of an edge table, by large-star and small-star steps between written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import Written

EDGES = "u long, v long"
#: Parts that the rows of a hot key are dealt in.
PARTS = 32
#: Edges that one task contracts.
TASK_EDGES = 250_000


def hot_limit(rows: int) -> int:
    """Rows that make a key hot; at most a hundred thousand keys of a table can have that many."""
    return max(1000, rows // 100_000)


def joined_apart(left: DataFrame, right: DataFrame, keys: list[str], spread: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row for each key); the rows of the ``hot`` keys, a bounded table, are dealt by
    ``spread`` too, and ``right`` has its row for them once for each part."""
    marked = F.broadcast(hot.withColumn("hot_", F.lit(True)))
    part = F.when(F.col("hot_"), F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int")).otherwise(0)
    parts = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    one = left.join(marked, keys, "left").withColumn("part_", part).drop("hot_")
    two = right.join(marked, keys, "left").withColumn("part_", F.explode(parts)).drop("hot_")
    return one.join(two.hint("merge"), [*keys, "part_"], how).drop("part_")


def forest(edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is joined with) for every node of some edges that isn't the smallest itself."""
    u, v = (np.concatenate(x) for x in zip(*edges))
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _contract(batches):
    """Edges of one partition as a forest, a bounded number of them at a time."""
    held, count = [], 0

    def out():
        u, v = forest(held)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count > 500_000:
            yield out()
            held, count = [], 0
    if held:
        yield out()


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first())


def connected_components(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (u, v) is joined with.

    Tasks of about ``task_edges`` edges contract theirs to stars, whatever the number of shuffle partitions. Each round
    then reads a written table and makes two grouped minima; their number grows with the logarithm of the longest path
    between the tasks' stars. Only counts and two sums come to the driver.
    """
    rows = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v")
    now = Written(rows.coalesce(rows.count() // task_edges + 1).mapInArrow(_contract, EDGES))
    before = _sums(now.df)
    limit = hot_limit(2 * before[0])

    def near(rows):
        """(u, m, many): the smallest neighbour of each u, and how many it has."""
        return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))

    def moved(rows, low):
        return joined_apart(rows, low.select("u", "m"), ["u"], "v", low.where(F.col("many") > limit).select("u"))

    for _ in range(most_rounds):
        # large star: the larger neighbours of u move to u's smallest neighbour
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near(both).withColumn("m", F.least("m", "u"))
        large = moved(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: the smaller neighbours of u, and u, move to the smallest
        low = near(large)
        small = moved(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = Written(small)
        now.drop()
        now = after
        sums = _sums(now.df)
        if before == sums:
            break
        before = sums
    else:
        raise RuntimeError("components did not settle")
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.df.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
