"""Per-pixel maps: column expressions that stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of blue, green and red in gray, in thousandths (fixed values).
GRAY_WEIGHTS = (114, 587, 299)


def to_gray(b: Column, g: Column, r: Column) -> Column:
    return F.floor((b * GRAY_WEIGHTS[0] + g * GRAY_WEIGHTS[1] + r * GRAY_WEIGHTS[2]) / 1000).cast("long")


def binarise(v: Column, t: int, top: int = 255) -> Column:
    return F.when(v > t, F.lit(top)).otherwise(F.lit(0)).cast("long")


def to_zero(v: Column, t: int) -> Column:
    return F.when(v > t, v).otherwise(F.lit(0)).cast("long")


def invert(v: Column) -> Column:
    return F.lit(255) - v


def saturate(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def blend(a: Column, alpha: float, b: Column, beta: float, gamma: float = 0.0) -> Column:
    """Saturating weighted sum, rounded half up."""
    return saturate(F.floor(a * alpha + b * beta + gamma + 0.5)).cast("long")


def saturated_abs(v: Column) -> Column:
    return F.least(F.abs(v), F.lit(255)).cast("long")


def stretch(df: DataFrame, value: str, out: str = "v", top: int = 255, by: str = "img") -> DataFrame:
    """Min-max normalisation within an image; a flat image becomes 0.

    The extremes are grouped partially on the map side and joined back, so no image's pixels need to meet in one task.
    """
    ends = df.groupBy(by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col(value) - F.col("__lo")) * top / (F.col("__hi") - F.col("__lo")))).otherwise(0)
    return df.join(ends, by).withColumn(out, scaled.cast("long")).drop("__lo", "__hi")


def visible(score: Column) -> Column:
    """A score in [0, 1] as an 8-bit level."""
    return F.floor(score * 255).cast("long")


def without_nan(v: Column) -> Column:
    return F.nanvl(v, F.lit(0.0))


def _linear(c: Column) -> Column:
    u = c / 255.0
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def _curve(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* of sRGB levels under D65 (published matrix and white point)."""
    lb, lg, lr = _linear(b), _linear(g), _linear(r)
    x = (lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456
    y = lr * 0.212671 + lg * 0.715160 + lb * 0.072169
    z = (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.088754
    fx, fy, fz = _curve(x), _curve(y), _curve(z)
    light = F.when(y > 0.008856, F.cbrt(y) * 116 - 16).otherwise(y * 903.3)
    return light, (fx - fy) * 500, (fy - fz) * 200


def crop(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """The pixels inside each rectangle of their image, in the rectangle's own coordinates."""
    r = rects.select("img", "id", F.col("x").alias("rx"), F.col("y").alias("ry"), "w", "h")
    inside = (F.col("x") >= F.col("rx")) & (F.col("x") < F.col("rx") + F.col("w")) & (F.col("y") >= F.col("ry")) & (F.col("y") < F.col("ry") + F.col("h"))
    return pixels.join(r, "img").where(inside).withColumn("x", F.col("x") - F.col("rx")).withColumn("y", F.col("y") - F.col("ry")).drop("rx", "ry", "w", "h")


def rescale(rects: DataFrame, levels: int) -> DataFrame:
    return rects.select("img", "id", *[F.shiftleft(c, levels).alias(c) for c in ("x", "y", "w", "h")])


def clamp_rect(rects: DataFrame, width: int, height: int) -> DataFrame:
    """Rectangles clipped to the frame; a negative origin moves to 0 and keeps the size, which is then clipped."""
    x, y = F.greatest("x", F.lit(0)), F.greatest("y", F.lit(0))
    return rects.select("img", "id", x.alias("x"), y.alias("y"), F.least(F.col("w"), width - x).alias("w"), F.least(F.col("h"), height - y).alias("h"))


def direction(degrees: Column, bins: int = 8) -> Column:
    """The sector 1..bins of an angle, sectors centred on the axes."""
    step = 360 // bins
    return (F.floor((F.pmod(degrees + step / 2, F.lit(360))) / step) + 1).cast("long")


def label_color(label: Column) -> Column:
    """A fixed colour for each label."""
    return F.pmod(label * 2654435761, F.lit(16777216)).cast("long")


def unpivot_channels(df: DataFrame, channels: dict[str, str]) -> DataFrame:
    """One row for each channel: (img, y, x, channel, v)."""
    parts = ", ".join(f"'{n}', {c}" for n, c in channels.items())
    return df.select("img", "y", "x", F.expr(f"stack({len(channels)}, {parts}) as (channel, v)"))


def pivot_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    return df.groupBy("img", "y", "x").pivot("channel", channels).agg(F.max("v"))


def image_extent(df: DataFrame) -> DataFrame:
    return df.groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def shifted(df: DataFrame, order: str, by: tuple[str, ...], value: str, step: int) -> Column:
    """The value ``step`` places on in a row or column of a dense image."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.lead(value, step).over(w) if step > 0 else F.lag(value, -step).over(w)
