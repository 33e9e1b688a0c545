"""Region and colour statistics: grouped aggregates and joins of their results back to pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of one channel in the colour histogram.
BINS = 12


def color_key(b: Column, g: Column, r: Column) -> Column:
    """Quantised colour, twelve levels a channel (exact integer form of v / 255 * (12 - 0.0001))."""
    q = [F.floor(v * 119999 / 2550000).cast("long") for v in (b, g, r)]
    return q[0] * BINS * BINS + q[1] * BINS + q[2]


def histogram(colors: DataFrame) -> DataFrame:
    """(img, key, cnt, place): quantised colours by falling count, equal counts by falling key."""
    h = colors.groupBy("img", color_key(F.col("b"), F.col("gr"), F.col("r")).alias("key")).agg(F.count("*").alias("cnt"))
    return h.withColumn("place", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("cnt"), F.desc("key"))).cast("long"))


def kept_colors(hist: DataFrame, drop: float = 0.05, least: int = 10, most: int = 256) -> DataFrame:
    """(img, kept): how many of the most frequent colours remain when the tail below ``drop`` of the pixels goes."""
    tail = Window.partitionBy("img").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    total = hist.groupBy("img").agg(F.sum("cnt").alias("__total"), F.count("*").alias("__colors"))
    t = hist.withColumn("__tail", F.sum("cnt").over(tail)).join(total, "img")
    kept = t.groupBy("img", "__colors").agg(F.count_if(F.col("__tail") >= F.col("__total") * drop).alias("k"))
    return kept.select("img", F.least(F.greatest(F.col("k"), F.lit(least)), F.lit(most), F.col("__colors")).cast("long").alias("kept"))


def nearest_kept(hist: DataFrame, kept: DataFrame) -> DataFrame:
    """(img, key, near): the nearest remaining colour of each dropped one by squared level distance, the first in rank on a tie.

    An image has at most ``BINS ** 3`` colours, so the pairs of an image are bounded.
    """
    parts = lambda p: [F.expr(f"{p} div {BINS * BINS}"), F.expr(f"{p} div {BINS} % {BINS}"), F.expr(f"{p} % {BINS}")]
    h = hist.join(kept, "img")
    stay = h.where("place <= kept").select("img", F.col("key").alias("near"), F.col("place").alias("rank"))
    gone = h.where("place > kept").select("img", "key")
    pairs = gone.join(stay, "img")
    d = sum(((a - b) * (a - b) for a, b in zip(parts("key"), parts("near"))), F.lit(0))
    return pairs.groupBy("img", "key").agg(F.min_by("near", F.struct(d.alias("d"), F.col("rank"))).alias("near"))


def level_regions(pixels: DataFrame, step: int = 64) -> DataFrame:
    """Regions of like level: the label is the band of the gray value."""
    return pixels.withColumn("label", F.expr(f"g div {step}"))


def region_table(regions: DataFrame) -> DataFrame:
    """(img, label, n, sx, sy): size and coordinate sums of every region."""
    return regions.groupBy("img", "label").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


def mean_in_order(points: Column, value) -> Column:
    """The mean of ``value(point)`` over an array, added up from its first element on; null for an empty one.

    A mean that is rounded at a tie depends on the last bits of its sum, thus on the order of addition; partial sums would follow the partitions.
    """
    return F.try_divide(F.aggregate(points, F.lit(0.0), lambda s, p: s + value(p)), F.size(points))


def region_spread(regions: DataFrame) -> DataFrame:
    """(img, label, n, mx, my, adx, ady): size, centre and mean distance from the centre along each axis, added up in raster order.

    A task holds the pixels of one region at a time.
    """
    one = regions.groupBy("img", "label").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.sort_array(F.collect_list(F.struct("y", "x"))).alias("__points"))
    far = [mean_in_order(F.col("__points"), lambda p, v=v, m=m: F.abs(p[v] - F.col(m))).alias(n) for v, m, n in (("x", "mx", "adx"), ("y", "my", "ady"))]
    return one.select("img", "label", "n", "mx", "my", *far)


def paint(pixels: DataFrame, values: DataFrame, on=("img", "label")) -> DataFrame:
    """A value of each label on its pixels."""
    return pixels.join(values, list(on))


def in_polygon(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a point lies in a convex polygon (corners in order, either turn)."""
    crosses = []
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        crosses.append((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))
    left = right = F.lit(True)
    for k in crosses:
        left, right = left & (k >= 0), right & (k <= 0)
    return left | right


def f1_percent(p: Column, r: Column) -> Column:
    """The harmonic mean of precision and recall in whole per cent."""
    return F.when((p > 0) & (r > 0), F.floor(p * r * 200 / (p + r))).otherwise(0).cast("long")
