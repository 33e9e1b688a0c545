"""Lines, segments, rectangles and quadrangles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PI = math.pi


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once: a generator of one row keeps the optimizer from repeating a long expression at each use."""
    row = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return df.withColumn("__row", row).select(*df.columns, "__row.*")


def near(a: Column, b: float | Column, within: float) -> Column:
    return F.abs(a - b) < within


def polar(segments: DataFrame) -> DataFrame:
    """Adds ``rho`` and ``angle``: distance from the origin of the segment's line, and the direction of its normal in [0, 2 pi)."""
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    length = F.sqrt(dx * dx + dy * dy)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sign = F.when(cross < 0, -1.0).otherwise(1.0)
    angle = F.atan2(-dx * sign, dy * sign)
    full = F.when(angle < 0, angle + 2 * PI).otherwise(angle)
    return segments.withColumn("rho", F.when(length > 0, F.abs(cross) / length)).withColumn("angle", F.when(length > 0, F.when(full >= 2 * PI, 0.0).otherwise(full)))


def squared_length(s: DataFrame | None = None, p: str = "") -> Column:
    dx, dy = F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1")
    return dx * dx + dy * dy


def is_vertical(angle: Column) -> Column:
    """The normal is within 45 degrees of the horizontal; the limits belong to both classes."""
    return angle.between(0, PI / 4) | angle.between(PI * 3 / 4, PI * 5 / 4) | angle.between(PI * 7 / 4, 2 * PI)


def is_horizontal(angle: Column) -> Column:
    return angle.between(PI / 4, PI * 3 / 4) | angle.between(PI * 5 / 4, PI * 7 / 4)


def upright(angle: Column) -> Column:
    return near(angle, 0.0, PI / 24) | near(angle, PI, PI / 24)


def level(angle: Column) -> Column:
    return near(angle, PI / 2, PI / 36)


def to_vertical(angle: Column) -> Column:
    """Angle between the normal and the horizontal axis, in [0, pi / 2]."""
    return F.when(angle <= PI / 2, angle).when(angle <= PI * 3 / 2, F.abs(angle - PI)).otherwise(2 * PI - angle)


def to_horizontal(angle: Column) -> Column:
    return F.abs(PI / 2 - to_vertical(angle))


def perspective_pair(a: Column, b: Column) -> Column:
    """Two near-horizontal sides that converge alike, or run alike."""
    def leaning(r, left):
        return r.between(0, PI / 2) & left.between(PI / 2, PI)

    even = F.abs((PI / 2 - F.least(a, b)) - (F.greatest(a, b) - PI / 2)) <= PI / 10
    return F.when(leaning(a, b) | leaning(b, a), even).otherwise(F.abs(a - b) < 0.05)


def upright_pair(a: Column, b: Column) -> Column:
    """Two near-vertical sides: both within 12 degrees of upright on one side, or leaning symmetrically by less than 7.2 degrees' difference."""
    first, third, fourth = (lambda x: x.between(0, PI / 2)), (lambda x: x.between(PI / 2, PI)), (lambda x: x.between(PI * 3 / 2, 2 * PI))
    lean = PI / 15
    same = (first(a) & first(b) & (a < lean) & (b < lean)) | (fourth(a) & fourth(b) & (2 * PI - a < lean) & (2 * PI - b < lean))
    opposed = lambda x, y: third(x) & fourth(y) & (PI - x < lean) & (2 * PI - y < lean)
    mirrored = lambda x, y: first(x) & fourth(y) & (F.abs(x - (2 * PI - y)) < PI / 25)
    return same | opposed(a, b) | opposed(b, a) | mirrored(a, b) | mirrored(b, a)


def like_rectangle(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the sides (a, b) and (c, d) may bound a photographed rectangle: the first rule that applies decides."""
    return (
        F.when(upright(a) & upright(b), perspective_pair(c, d))
        .when(upright(c) & upright(d), perspective_pair(a, b))
        .when(level(a) & level(b), upright_pair(c, d))
        .when(level(c) & level(d), upright_pair(a, b))
        .otherwise(F.lit(True))
    )


def same_quadrant(a: Column, b: Column) -> Column:
    return F.floor(a / (PI / 2)) == F.floor(b / (PI / 2))


def outside_frame_angles(angle: Column) -> Column:
    """Neither within 30 degrees of a level nor of an upright side (first and last twelfth only)."""
    return ~(angle.between(PI / 3, 2 * PI / 3) | angle.between(4 * PI / 3, 5 * PI / 3) | angle.between(0, PI / 6) | angle.between(PI * 11 / 6, 2 * PI))


def angle_between(a: Column, b: Column, c: Column) -> Column:
    """The angle opposite side c of a triangle with sides a, b, c."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a * a + b * b - c * c) / (2 * a * b))))


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = (x1 - x2).cast("double"), (y1 - y2).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def meeting_point(p: str, q: str) -> tuple[Column, Column]:
    """The intersection of the lines through two segments; null if they are parallel."""
    c = lambda s, n: F.col(f"{s}{n}").cast("double")
    x1, y1, x2, y2 = (c(p, n) for n in ("x1", "y1", "x2", "y2"))
    x3, y3, x4, y4 = (c(q, n) for n in ("x1", "y1", "x2", "y2"))
    d = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    return F.when(d != 0, (a * (x3 - x4) - (x1 - x2) * b) / d), F.when(d != 0, (a * (y3 - y4) - (y1 - y2) * b) / d)


def overlap(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(r1, r2) - F.greatest(l1, l2))


def rect_overlap_ratio(compat: bool = False) -> Column:
    """Common area of rectangles a and b over the smaller area; ``compat`` takes the height of the joint span."""
    c = F.col
    w = overlap(c("ax"), c("ax") + c("aw"), c("bx"), c("bx") + c("bw"))
    h = overlap(c("ay"), c("ay") + c("ah"), c("by"), c("by") + c("bh"))
    if compat:
        span = F.greatest(c("ay") + c("ah"), c("by") + c("bh")) - F.least("ay", "by")
        h = F.when(w > 0, span).otherwise(0)
    return w * h / F.least(c("aw") * c("ah"), c("bw") * c("bh"))


def opposite_sides(width: int, height: int, open_by: float = 0.25, gap: float = 0.02) -> Column:
    """Whether lines a and b may be opposite sides: near anti-parallel, or near parallel on both sides of the centre, and apart."""
    c = F.col
    dangle = F.abs(c("aangle") - c("bangle"))
    anti = dangle.between(PI * (1 - open_by), PI * (1 + open_by))
    alike = (dangle <= PI * open_by) | dangle.between((2 - open_by) * PI, 2 * PI)

    def side(p):
        return c(f"{p}rho") / (F.cos(c(f"{p}angle")) + F.sin(c(f"{p}angle")) * height / width) - 0.5 * width

    apart = F.when(anti, c("arho") + c("brho")).otherwise(F.abs(c("arho") - c("brho")))
    return (anti | (alike & (side("a") * side("b") < 0))) & (apart > gap * width) & (apart > gap * height)


def paired(segments: DataFrame, *keep: str) -> DataFrame:
    """Pairs a, b of an image's rows with a.id < b.id; the columns get the prefixes a and b."""
    a = segments.select("img", *[F.col(c).alias(f"a{c}") for c in ("id", *keep)])
    b = segments.select("img", *[F.col(c).alias(f"b{c}") for c in ("id", *keep)])
    return a.join(b, "img").where("aid < bid")


def ordered_corners(points: DataFrame) -> DataFrame:
    """Of four points (id, k, x, y) the corners top left, top right, bottom right, bottom left about their centre; none unless two are above it."""
    w = Window.partitionBy("img", "id")
    n = F.count("*").over(w)
    above = F.col("y") * n < F.sum("y").over(w)
    p = points.withColumn("above", above)
    up = F.sort_array(F.collect_list(F.when(F.col("above"), F.struct("x", "y"))))
    down = F.sort_array(F.collect_list(F.when(~F.col("above"), F.struct("x", "y"))))
    g = p.groupBy("img", "id").agg(up.alias("u"), down.alias("d")).where("size(u) = 2 and size(d) = 2")
    corner = {"tl": ("u", 0), "tr": ("u", 1), "br": ("d", 1), "bl": ("d", 0)}
    return g.select("img", "id", *[F.col(a)[k][c].alias(f"{n}_{c}") for n, (a, k) in corner.items() for c in ("x", "y")])
