"""Operator 8: approximate nearest neighbours along shifted space-filling curves.

Method: every curve turns the vectors by a random rotation, keeps the first ``PROJECTED``
coordinates, shifts them and orders the rows by their Hilbert key. Spark partitions the rows
of all curves by ranges of (curve, block), a block being a stretch of neighbouring keys; a
query is laid beside its own block and the two next to it. In each window the nearest rows
are found on 16-bit copies of the vectors, with a bound of what rounding can hide; the
windows of all curves are merged, and the few candidates left are ranked by their exact
distance on the original vectors. So a row travels once for each curve with its id and two
bytes for each dimension, and in full only as a candidate.

The bounds of the blocks are fitted on the ``SAMPLE`` vectors with the smallest hashes (a
fixed bound); every row is indexed. Vectors that are equal in all components are one entry
that carries its smallest ids, as many as an answer can hold, so thousands of copies of one
vector neither fill a block nor lose an answer: those are exactly the ids that ties prefer.

A block holds ``1 / BLOCKS`` of the rows and at most about ``MOST_ROWS``. The number of curves
and the share of a block set the recall: vectors spread evenly over 64 dimensions have no
order that keeps all neighbours near, and narrow windows on many curves cost fewest distances
for 0.9 there. Beyond ``BLOCKS * MOST_ROWS`` rows the share of a block falls, and with it the
recall on such data; on data with fewer dimensions in effect, fewer curves do.

Defined results: a vector that is null, zero, or holds a null or non-finite component takes
no part, nor one whose length is not the most frequent one (ties: the smaller length); of
rows with one vec_id the smallest vector counts; null ids take no part; fewer than ``k``
candidates give fewer rows; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelattice.llm.common import U64, Written, table, text_buffer

K = 10
EVERY = 100
CURVES = 48
BLOCKS = 240
#: Rows in a block at least, and at most about.
LEAST, MOST_ROWS = 64, 65_536
PROJECTED, BITS = 12, 4
SAMPLE = 20_000
SEED = 17


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places of integer points (rows) along the Hilbert curve, as dimensions * bits bit numbers (64 at most).

    Gray-code form: undo the excess work of each level from the top bit down, Gray-encode, interleave.
    """
    x = cells.astype(U64).copy()
    dims = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        q, p = U64(level), U64(level - 1)
        for i in range(dims):
            high = (x[:, i] & q) > 0
            swap = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] ^= np.where(high, p, swap)
            if i:
                x[:, i] ^= np.where(high, U64(0), swap)
        level >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), U64)
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[:, -1] & U64(level)) > 0, U64(level - 1), U64(0))
        level >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), U64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << U64(1)) | ((x[:, i] >> U64(b)) & U64(1))
    return key


class Curves:
    """Rotations, shifts and the bounds of the blocks."""

    def __init__(self, sample: np.ndarray, rows: int, curves: int = CURVES, blocks: int = BLOCKS, projected: int = PROJECTED, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        projected = min(projected, size)
        self.bits = bits
        self.turn = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, :projected] for _ in range(curves)]
        shift = rng.random((curves, projected)) / 4
        self.low, self.step, self.bounds = [], [], []
        for c in range(curves):
            made = sample @ self.turn[c]
            low, high = made.min(0), made.max(0)
            width = np.maximum(high - low, 1e-12) * 1.25
            self.low.append(low - shift[c] * width / 1.25)
            self.step.append(width / (1 << bits))
        count = max(1, min(max(blocks, rows // MOST_ROWS), rows // LEAST))
        spread = np.arange(len(sample), dtype=U64)
        for c in range(curves):
            keys = np.sort(self.keys(c, sample, spread))
            self.bounds.append(keys[(np.arange(1, count) * len(keys)) // count])

    def keys(self, c: int, vectors: np.ndarray, spread: np.ndarray) -> np.ndarray:
        cells = np.clip((vectors @ self.turn[c] - self.low[c]) / self.step[c], 0, (1 << self.bits) - 1)
        key = hilbert_keys(cells.astype(np.int64), self.bits)
        used = self.bits * cells.shape[1]
        free = min(16, 64 - used)  # rows of one cell are spread by their id
        return key << U64(free) | ((spread * U64(0x9E3779B97F4A7C15)) >> U64(64 - free) if free else U64(0))

    def blocks(self, c: int, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds[c], keys, "right").astype(np.int32)

    def last(self, c: int) -> int:
        return len(self.bounds[c])


LAID = "curve int, block int, asks boolean, id long, scale double, v binary"
NAMES = ["curve", "block", "asks", "id", "scale", "v"]
STEPS = 32767


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, 16-bit components) of each vector: component = scale * integer, up to half the scale."""
    scale = np.maximum(np.abs(vectors).max(1), 1e-300) / STEPS
    return scale, np.rint(vectors / scale[:, None]).astype(np.int16)


def entries(vectors: DataFrame, k: int = K) -> DataFrame:
    """(ids, v): every distinct usable vector as float64 bytes with its k + 1 smallest ids."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and e is not null and size(e) > 0")
    usable = usable.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("e", lambda x: x != 0))
    length = usable.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = length[0]["n"] if length else 0
    # adding 0 makes -0 and 0 one
    one = usable.where(F.size("e") == n).select("vec_id", F.transform("e", lambda x: x + F.lit(0.0)).alias("e")).groupBy("vec_id").agg(F.min("e").alias("e"))
    place = Window.partitionBy("e").orderBy("vec_id")
    few = one.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    return few.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, curves: int = CURVES, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries`` among all rows but its own.

    Both have vec_id and embedding. An entry goes by the smallest of its ids. A block's task holds its entries, a
    bounded number, and streams its queries.
    """
    all_rows = Written(entries(vectors, k).withColumn("id", F.col("ids")[0])).df
    total = all_rows.count()
    asked = Written(entries_of_queries(queries)).df
    sample = all_rows.select("e", F.xxhash64("e").alias("h")).orderBy("h", "e").limit(SAMPLE).toPandas()
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    made = Curves(np.array(sample["e"].tolist(), float), total, curves, blocks, seed=seed)
    size = made.turn[0].shape[0]
    sent = vectors.sparkSession.sparkContext.broadcast(made)

    def lay(batches):
        own = sent.value
        for batch in batches:
            asks, id_ = batch.column(0).to_numpy(zero_copy_only=False).astype(bool), batch.column(1).to_numpy()
            e = batch.column(2)
            vectors = np.array(e.values.to_numpy(zero_copy_only=False)[e.offsets[0].as_py() : e.offsets[-1].as_py()], float).reshape(-1, size)
            scale, small = rounded(vectors)
            spread = (id_ & 0x7FFFFFFFFFFFFFFF).astype(U64)
            for c in range(len(own.turn)):
                block = own.blocks(c, own.keys(c, vectors, spread))
                rows = np.concatenate([np.flatnonzero(~asks), *[np.flatnonzero(asks)] * 3])
                where = block[rows] + np.repeat([0, -1, 0, 1], [(~asks).sum(), *[asks.sum()] * 3])
                ok = (where >= 0) & (where <= own.last(c))
                rows, where = rows[ok], where[ok]
                n = len(rows)
                if n:
                    v = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * 2 * size, 2 * size, dtype=np.int32)), pa.py_buffer(small[rows].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(where.astype(np.int32)), pa.array(asks[rows]), pa.array(id_[rows]), pa.array(scale[rows]), v], NAMES)

    both = all_rows.select(F.lit(False).alias("asks"), "id", "e").union(asked.where(F.size("e") == size).select(F.lit(True), F.col("vec_id"), "e"))
    laid = both.mapInArrow(lay, LAID).repartitionByRange("curve", "block").sortWithinPartitions("curve", "block", "asks")
    found = laid.mapInArrow(_near(k, size), "query_id long, id long, least double, most double")
    # k + 1 entries hold k ids besides the query's own; what may be nearer than the last of them stays
    one = found.groupBy("query_id", "id").agg(F.max("least").alias("least"), F.min("most").alias("most"))
    place = Window.partitionBy("query_id").orderBy("most", "id")
    edge = F.max(F.when(F.col("place") <= k + 1, F.col("most"))).over(Window.partitionBy("query_id"))
    close = one.withColumn("place", F.row_number().over(place)).withColumn("edge", edge).where("least <= edge").select("query_id", "id")
    exact = close.join(all_rows.select("id", "ids", "e").hint("merge"), "id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")).hint("merge"), "query_id")
    gap = F.zip_with("e", "q", lambda a, b: (a - b) * (a - b))
    scored = exact.withColumn("score", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))).select("query_id", F.explode("ids").alias("vec_id"), "score")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = scored.where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def entries_of_queries(queries: DataFrame) -> DataFrame:
    rows = entries(queries, 0).select("e", F.col("ids")[0].alias("vec_id"))
    # equal query vectors are one entry above: join their ids back
    own = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("e")).where("vec_id is not null and e is not null").groupBy("vec_id").agg(F.min("e").alias("e"))
    return own.join(rows.select("e"), "e", "left_semi")


def _near(k: int, size: int):
    """Of laid rows ordered by curve, block, entries first: for each query the entries of each block that may be among
    the k + 1 nearest there, with the bounds of their distances."""

    def unpacked(part):
        scale = part.column(4).to_numpy()
        raw = text_buffer(part.column(5))[0].view(np.int16).reshape(len(scale), size)
        return part.column(3).to_numpy(), raw * scale[:, None], scale * (0.5 * np.sqrt(size))

    def best(held, asked):
        """Both: (ids, vectors, how far rounding may have moved each)."""
        (ids, v, off), (names, q, own) = held, asked
        norms = (q * q).sum(1)[:, None] + (v * v).sum(1)[None]
        square = np.maximum(norms - 2 * q @ v.T, 0)
        moved = own[:, None] + off[None] + 1e-7 * np.sqrt(norms)  # the last for the sums' own rounding
        far = np.sqrt(square)
        take = min(len(v), k + 1)
        edge = np.partition(far + moved, take - 1, axis=1)[:, take - 1]
        rows, places = np.nonzero(far - moved <= edge[:, None])
        far, moved = far[rows, places], moved[rows, places]
        return pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(ids[places]), pa.array(far - moved), pa.array(far + moved)], ["query_id", "id", "least", "most"])

    def run(batches):
        name, parts, held = None, [], None
        for batch in batches:
            curve, block, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            new = np.ones(len(curve), bool)
            new[1:] = (curve[1:] != curve[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])
            edge = np.flatnonzero(new)
            for b, e in zip(edge.tolist(), np.append(edge[1:], len(curve)).tolist()):
                if (curve[b], block[b]) != name:
                    name, parts, held = (curve[b], block[b]), [], None
                part = unpacked(batch.slice(b, e - b))
                if not asks[b]:
                    parts.append(part)
                elif parts:
                    if held is None:
                        held = tuple(np.concatenate(x) for x in zip(*parts))
                    step = max(1, (1 << 21) // len(held[0]))
                    for i in range(0, e - b, step):
                        yield best(held, tuple(x[i : i + step] for x in part))

    return run


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
