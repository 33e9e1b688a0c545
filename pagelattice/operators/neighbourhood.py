"""Neighbourhood operators as row-frame windows over dense images.

Frames slide over one image row (img, y) or column (img, x) at a time, so a task sorts
single rows and never holds an image; box sums of any size take two prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.operators.components import RING



def row():
    return Window.partitionBy("img", "y").orderBy("x")


def column():
    return Window.partitionBy("img", "x").orderBy("y")


def box_sums(df: DataFrame, value: str, radius: int) -> DataFrame:
    """Adds s and q: sum and sum of squares of the (2 radius + 1)-box, null unless the box lies inside the image."""
    r, k = radius, 2 * radius + 1
    along, down = row().rowsBetween(-r, r), column().rowsBetween(-r, r)
    out = df.withColumn("__s", F.sum(value).over(along)).withColumn("__q", F.sum(F.col(value) * F.col(value)).over(along)).withColumn("__n", F.count("*").over(along))
    full = F.sum("__n").over(down) == k * k
    return out.withColumn("s", F.when(full, F.sum("__s").over(down))).withColumn("q", F.when(full, F.sum("__q").over(down))).drop("__s", "__q", "__n")


def integral(df: DataFrame, value: str, out: str = "total") -> DataFrame:
    """The sum over everything above and to the left, the pixel included."""
    rows = df.withColumn("__row", F.sum(value).over(row().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn(out, F.sum("__row").over(column().rowsBetween(Window.unboundedPreceding, 0))).drop("__row")


def at(value: str | Column, step: int, window=None) -> Column:
    window = row() if window is None else window
    return F.lead(value, step).over(window) if step > 0 else F.lag(value, -step).over(window) if step < 0 else (F.col(value) if isinstance(value, str) else value)


def sobel(df: DataFrame, value: str) -> DataFrame:
    """Adds gx and gy, null at the image's edge."""
    out = df.withColumn("__d", at(value, 1) - at(value, -1)).withColumn("__m", at(value, -1) + F.col(value) * 2 + at(value, 1))
    return out.withColumn("gx", at("__d", -1, column()) + F.col("__d") * 2 + at("__d", 1, column())).withColumn("gy", at("__m", 1, column()) - at("__m", -1, column())).drop("__d", "__m")


def smooth(df: DataFrame, value: str, weights: tuple[int, ...], out: str = "v") -> DataFrame:
    """Separable symmetric filter with integer weights (their squared sum divides the result), null near the edge."""
    r, total = len(weights) // 2, sum(weights) ** 2
    across = sum((at(value, k - r) * w for k, w in enumerate(weights)), F.lit(0))
    rows = df.withColumn("__h", across)
    down = sum((at("__h", k - r, column()) * w for k, w in enumerate(weights)), F.lit(0))
    return rows.withColumn(out, F.floor((down + total // 2) / total).cast("long")).drop("__h")


def gradient(df: DataFrame, value: str, out: str = "v2") -> DataFrame:
    """Twice the horizontal central difference with replicated border."""
    return df.withColumn(out, F.coalesce(at(value, 1), F.col(value)) - F.coalesce(at(value, -1), F.col(value)))


def extreme(df: DataFrame, value: str, radius: int) -> DataFrame:
    """Adds lo and hi: minimum (erosion) and maximum (dilation) over the box, cut at the image's edge."""
    along, down = row().rowsBetween(-radius, radius), column().rowsBetween(-radius, radius)
    out = df.withColumn("__lo", F.min(value).over(along)).withColumn("__hi", F.max(value).over(along))
    return out.withColumn("lo", F.min("__lo").over(down)).withColumn("hi", F.max("__hi").over(down)).drop("__lo", "__hi")




def ring(df: DataFrame, value: str) -> DataFrame:
    """Adds n0..n7, the neighbours in the order of ``RING`` (null outside)."""
    out = df.withColumns({f"__{d}": at(value, d) for d in (-1, 1)})
    pick = lambda dx: f"__{dx}" if dx else value
    return out.withColumns({f"n{k}": at(pick(dx), dy, column()) if dy else F.col(pick(dx)) for k, (dy, dx) in enumerate(RING)}).drop("__-1", "__1")


def lower_code(df: DataFrame, value: str, out: str = "code") -> DataFrame:
    """The bits of the neighbours that are not zero and smaller than the pixel."""
    r = ring(df, value)
    code = sum((F.when((F.col(f"n{k}") != 0) & (F.col(f"n{k}") < F.col(value)), 1 << k).otherwise(0) for k in range(8)), F.lit(0))
    return r.withColumn(out, code.cast("long")).drop(*[f"n{k}" for k in range(8)])


def local_threshold(df: DataFrame, value: str, radius: int, rule: str, k: float = 0.5, span: float = 128.0) -> DataFrame:
    """Adds th, the threshold surface of niblack, sauvola or wolf, for pixels whose box lies inside the image."""
    n = (2 * radius + 1) ** 2
    s = box_sums(df, value, radius).where("s is not null")
    s = s.withColumn("__m", F.col("s") / n).withColumn("__sd", F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / n) / n)))
    if rule == "niblack":
        th = F.col("__m") + F.col("__sd") * k
    elif rule == "sauvola":
        th = F.col("__m") * ((F.col("__sd") / span - 1) * k + 1)
    else:
        ends = s.groupBy("img").agg(F.max("__sd").alias("__top"), F.min(value).alias("__low"))
        s = s.join(ends, "img")
        th = F.col("__m") + (F.col("__sd") / F.col("__top") - 1) * k * (F.col("__m") - F.col("__low"))
    return s.withColumn("th", th).drop("__m", "__sd", "__top", "__low", "s", "q")


def window_divisor(level: Column) -> Column:
    """Divisor of the binarisation window for a noise level."""
    return F.when(level < 1, 3.5).when(level < 1.5, level).otherwise((level - 1.6) / 1.4 * 14 + 1)


def majority_tiles(df: DataFrame, value: str, side: int = 3, light: int = 128) -> DataFrame:
    """Each complete tile takes the colour of most of its pixels, black on a tie; other pixels stay as they are."""
    tile = [F.expr(f"y div {side}").alias("ty"), F.expr(f"x div {side}").alias("tx")]
    votes = df.groupBy("img", *tile).agg(F.count_if(F.col(value) > light).alias("__white"), F.count("*").alias("__n"))
    out = df.select("*", *tile).join(votes, ["img", "ty", "tx"])
    v = F.when(F.col("__n") == side * side, F.when(F.col("__white") * 2 > F.col("__n"), 255).otherwise(0)).otherwise(F.col(value))
    return out.withColumn("v", v.cast("long")).drop("ty", "tx", "__white", "__n")
