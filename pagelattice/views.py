"""Integer raster, segment, rectangle and text views of Parquet tables, as DataFrames and as DuckDB SQL.

Both forms of a view have the same rows, so that operators over them can be compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.operators.geometry import computed, polar

#: Rows (vectors) of one image in the gray view, and its width.
SIDE = 64


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_at() -> Column:
    """Where a row of a loaded table stands: its file and its place there."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _level(v):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 256 + 128))).cast("int")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, g): one vector is one row of an image of 64 rows."""
    e = load(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {SIDE}").alias("img"), (F.col("vec_id") % SIDE).alias("y"), F.posexplode("embedding").alias("x", "v"))
    return e.select("img", "y", F.col("x").cast("long").alias("x"), _level(F.col("v")).cast("long").alias("g"))


def color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, b, gr, r): three vectors are the channels of one row; incomplete triples are dropped."""
    e = load(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {3 * SIDE}").alias("img"), F.expr(f"vec_id % {3 * SIDE} div 3").alias("y"), (F.col("vec_id") % 3).alias("c"), F.posexplode("embedding").alias("x", "v"))
    one = e.groupBy("img", "y", "x").agg(*[F.max(F.when(F.col("c") == k, _level(F.col("v")))).cast("long").alias(n) for k, n in enumerate(("b", "gr", "r"))])
    return one.where("b is not null and gr is not null and r is not null").withColumn("x", F.col("x").cast("long"))


def mask(spark: SparkSession, sf_dir: str, above: int = 160) -> DataFrame:
    """(img, y, x) of the pixels over ``above``."""
    return gray(spark, sf_dir).where(F.col("g") > above).select("img", "y", "x")


def dark(spark: SparkSession, sf_dir: str, below: int = 96) -> DataFrame:
    return gray(spark, sf_dir).where(F.col("g") < below).select("img", "y", "x")


def segments(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(img, id, x1, y1, x2, y2, score) and ``more``: line segments, an order is an image and a line item a segment."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("img"),
        F.col("l_linenumber").cast("long").alias("id"),
        (F.col("l_partkey") % 500).cast("long").alias("x1"),
        (F.col("l_suppkey") * 7 % 500).cast("long").alias("y1"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 500).cast("long").alias("x2"),
        ((F.col("l_quantity").cast("long") * 37 + F.col("l_linenumber") * 59) % 500).cast("long").alias("y2"),
        F.col("l_quantity").cast("long").alias("score"),
        *more,
    )


def polar_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments with ``rho`` and ``angle``, rounded so that engines agree at the limits of a predicate."""
    s = segments(spark, sf_dir)
    p = polar(s).where("rho is not null")
    p = p.select(*s.columns, F.col("rho").alias("__rho"), F.col("angle").alias("__angle"))
    out = computed(p, {"rho": F.floor(F.col("__rho") * 1e6 + 0.5) / 1e6, "angle": F.floor(F.col("__angle") * 1e9 + 0.5) / 1e9})
    return out.drop("__rho", "__angle")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, id, x, y, w, h): rectangles, sixteen parts to an image."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        F.expr("p_partkey div 16").alias("img"), k.cast("long").alias("id"), (k * 37 % 200).cast("long").alias("x"), (k * 53 % 200).cast("long").alias("y"),
        (F.col("p_size") + 10).cast("long").alias("w"), (k * 7 % 40 + 5).cast("long").alias("h"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, y, line): the lines of every document."""
    d = load(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("y", "line")).withColumn("y", F.col("y").cast("long"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("p"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b): each part's name beside the next one's."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")


_LEVEL = "CAST(greatest(0, least(255, floor(CAST({v} AS DOUBLE) * 256 + 128))) AS BIGINT)"
SQL = {
    "gray": f"gray AS (SELECT vec_id // {SIDE} AS img, vec_id % {SIDE} AS y, CAST(i - 1 AS BIGINT) AS x, {_LEVEL.format(v='embedding[i]')} AS g FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))",
    "color": f"color AS (SELECT img, y, x, b, gr, r FROM (SELECT vec_id // {3 * SIDE} AS img, vec_id % {3 * SIDE} // 3 AS y, CAST(i - 1 AS BIGINT) AS x, max(CASE WHEN vec_id % 3 = 0 THEN v END) AS b, max(CASE WHEN vec_id % 3 = 1 THEN v END) AS gr, max(CASE WHEN vec_id % 3 = 2 THEN v END) AS r FROM (SELECT vec_id, i, {_LEVEL.format(v='embedding[i]')} AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) GROUP BY ALL) WHERE b IS NOT NULL AND gr IS NOT NULL AND r IS NOT NULL)",
    "mask": "mask AS (SELECT img, y, x FROM gray WHERE g > 160)",
    "dark": "dark AS (SELECT img, y, x FROM gray WHERE g < 96)",
    "segments": "segments AS (SELECT CAST(l_orderkey AS BIGINT) AS img, CAST(l_linenumber AS BIGINT) AS id, CAST(l_partkey % 500 AS BIGINT) AS x1, CAST(l_suppkey * 7 % 500 AS BIGINT) AS y1, CAST((l_orderkey * 7 + l_linenumber * 131) % 500 AS BIGINT) AS x2, CAST((CAST(l_quantity AS BIGINT) * 37 + l_linenumber * 59) % 500 AS BIGINT) AS y2, CAST(l_quantity AS BIGINT) AS score FROM lineitem)",
    "polar": "polar AS (SELECT img, id, x1, y1, x2, y2, score, floor(rho * 1000000 + 0.5) / 1000000 AS rho, floor(CASE WHEN full_ >= 2 * pi() THEN 0.0::DOUBLE ELSE full_ END * 1000000000 + 0.5) / 1000000000 AS angle FROM (SELECT *, CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END AS full_ FROM (SELECT *, abs(x1 * y2 - x2 * y1) / sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS rho, atan2(-CAST(x2 - x1 AS DOUBLE) * CASE WHEN x1 * y2 - x2 * y1 < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END, CAST(y2 - y1 AS DOUBLE) * CASE WHEN x1 * y2 - x2 * y1 < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS a FROM segments WHERE x1 <> x2 OR y1 <> y2)))",
    "rects": "rects AS (SELECT p_partkey // 16 AS img, CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey * 37 % 200 AS BIGINT) AS x, CAST(p_partkey * 53 % 200 AS BIGINT) AS y, CAST(p_size + 10 AS BIGINT) AS w, CAST(p_partkey * 7 % 40 + 5 AS BIGINT) AS h FROM part)",
    "lines": "lines AS (SELECT doc, CAST(i - 1 AS BIGINT) AS y, parts[i] AS line FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))",
    "paths": "paths AS (SELECT page_id AS id, url AS p FROM pages)",
    "names": "names AS (SELECT a.p_partkey AS id, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)",
}
NEEDS = {"polar": ("segments",), "mask": ("gray",), "dark": ("gray",)}


def with_views(*names: str) -> str:
    """The WITH clause of the named views and what they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ", ".join(SQL[n] for n in order) + " "
