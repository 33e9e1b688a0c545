"""Queries of the per-pixel maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice import views as V
from pagelattice.operators import pointwise as P
from pagelattice.plans.registry import query

P_ = ("img", "y", "x")


@query("prj1", "color", "SELECT img, y, x, (b * 114 + gr * 587 + r * 299) // 1000 AS gray FROM color")
def prj1(spark, d):
    return V.color(spark, d).select(*P_, P.to_gray(F.col("b"), F.col("gr"), F.col("r")).alias("gray"))


_LIN = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_CURVE = "CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE {t} * 7.787 + 16.0::DOUBLE / 116.0 END"
_R3 = "CAST(floor({v} * 1000 + 0.5) AS BIGINT) AS {n}"


@query(
    "prj2",
    "color",
    f", lin AS (SELECT img, y, x, {_LIN.format(c='b')} AS lb, {_LIN.format(c='gr')} AS lg, {_LIN.format(c='r')} AS lr FROM color), "
    + "xyz AS (SELECT img, y AS py, x AS px, (lr * 0.412453::DOUBLE + lg * 0.357580::DOUBLE + lb * 0.180423::DOUBLE) / 0.950456::DOUBLE AS xx, lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE AS yy, (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.088754::DOUBLE AS zz FROM lin), "
    + f"f AS (SELECT img, py, px, yy, {_CURVE.format(t='xx')} AS fx, {_CURVE.format(t='yy')} AS fy, {_CURVE.format(t='zz')} AS fz FROM xyz) "
    + f"SELECT img, py AS y, px AS x, {_R3.format(v='(CASE WHEN yy > 0.008856 THEN cbrt(yy) * 116 - 16 ELSE yy * 903.3::DOUBLE END)', n='l')}, {_R3.format(v='((fx - fy) * 500)', n='a')}, {_R3.format(v='((fy - fz) * 200)', n='bb')} FROM f",
)
def prj2(spark, d):
    light, a, b = P.lab(F.col("b"), F.col("gr"), F.col("r"))
    r3 = lambda v: F.floor(v * 1000 + 0.5).cast("long")
    return V.color(spark, d).select(*P_, r3(light).alias("l"), r3(a).alias("a"), r3(b).alias("bb"))


@query("prj3", "gray", "SELECT img, y, x, CAST(g AS DOUBLE) / 255 AS v FROM gray")
def prj3(spark, d):
    return V.gray(spark, d).select(*P_, (F.col("g") / 255).alias("v"))


@query("prj4", "gray", "SELECT img, y, x, CAST(floor(CAST(g AS DOUBLE) / 256 * 255) AS BIGINT) AS b, CAST(floor(CAST(g AS DOUBLE) / 256 * 255) AS BIGINT) AS gr, CAST(floor(CAST(g AS DOUBLE) / 256 * 255) AS BIGINT) AS r FROM gray")
def prj4(spark, d):
    v = P.visible(F.col("g") / 256)
    return V.gray(spark, d).select(*P_, v.alias("b"), v.alias("gr"), v.alias("r"))


_STRETCH = "SELECT img, y, x, CASE WHEN max(g) OVER w > min(g) OVER w THEN (g - min(g) OVER w) * {top} // (max(g) OVER w - min(g) OVER w) ELSE 0 END AS v FROM gray WINDOW w AS (PARTITION BY img)"


@query("prj5", "gray", _STRETCH.format(top=255))
def prj5(spark, d):
    return P.stretch(V.gray(spark, d), "g").select(*P_, "v")


@query("prj6", "gray", _STRETCH.format(top=1000))
def prj6(spark, d):
    return P.stretch(V.gray(spark, d), "g", top=1000).select(*P_, "v")


@query("prj7", "gray", "SELECT img, y, x, 255 - g AS v FROM gray")
def prj7(spark, d):
    return V.gray(spark, d).select(*P_, P.invert(F.col("g")).alias("v"))


@query("prj8", "gray", "SELECT img, y, x, CAST(CASE WHEN g > 128 THEN 255 ELSE 0 END AS BIGINT) AS v FROM gray")
def prj8(spark, d):
    return V.gray(spark, d).select(*P_, P.binarise(F.col("g"), 128).alias("v"))


@query("prj9", "gray", "SELECT img, y, x, CAST(CASE WHEN g > 128 THEN g ELSE 0 END AS BIGINT) AS v FROM gray")
def prj9(spark, d):
    return V.gray(spark, d).select(*P_, P.to_zero(F.col("g"), 128).alias("v"))


@query("prj10", "gray", "SELECT img, y, x, g >= 128 AS v FROM gray")
def prj10(spark, d):
    return V.gray(spark, d).select(*P_, (F.col("g") >= 128).alias("v"))


@query("prj11", "color", "SELECT img, y, x, CAST(greatest(0, least(255, floor(CAST(b AS DOUBLE) * 1.5 + CAST(r AS DOUBLE) * -0.5 + 3 + 0.5))) AS BIGINT) AS v FROM color")
def prj11(spark, d):
    return V.color(spark, d).select(*P_, P.blend(F.col("b"), 1.5, F.col("r"), -0.5, 3).alias("v"))


@query("prj12", "gray", "SELECT img, y, x, least(abs((g - 128) * 3), 255) AS v FROM gray")
def prj12(spark, d):
    return V.gray(spark, d).select(*P_, P.saturated_abs((F.col("g") - 128) * 3).alias("v"))


@query("prj13", "gray", "SELECT img, y, x, g & 1 AS odd, g & 240 AS high FROM gray")
def prj13(spark, d):
    return V.gray(spark, d).select(*P_, F.col("g").bitwiseAND(1).alias("odd"), F.col("g").bitwiseAND(240).alias("high"))


@query("prj14", "mask dark", "SELECT img, y, x FROM mask UNION SELECT img, y, x FROM dark")
def prj14(spark, d):
    return V.mask(spark, d).union(V.dark(spark, d)).distinct()


@query("prj15", "gray", "SELECT img, y, x, CASE WHEN (x + y) % 3 = 0 THEN 0 ELSE g END AS v FROM gray")
def prj15(spark, d):
    return V.gray(spark, d).select(*P_, F.when((F.col("x") + F.col("y")) % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("g")).alias("v"))


@query("prj16", "gray", "SELECT img, y, x, CAST(g AS DOUBLE) AS v FROM gray")
def prj16(spark, d):
    return V.gray(spark, d).select(*P_, F.col("g").cast("double").alias("v"))


@query("prj17", "gray", "SELECT img, y, x, CASE WHEN g % 7 = 0 THEN 0.0::DOUBLE ELSE CAST(g AS DOUBLE) END AS v FROM gray")
def prj17(spark, d):
    odd = F.when(F.col("g") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("g").cast("double"))
    return V.gray(spark, d).select(*P_, P.without_nan(odd).alias("v"))


@query("prj18", "gray rects", "SELECT g.img, r.id, g.y - r.y AS y, g.x - r.x AS x, g.g FROM gray g JOIN rects r ON g.img = r.img AND g.x >= r.x AND g.x < r.x + r.w AND g.y >= r.y AND g.y < r.y + r.h")
def prj18(spark, d):
    return P.crop(V.gray(spark, d), V.rects(spark, d)).select("img", "id", "y", "x", "g")


@query("prj19", "rects", "SELECT img, id, x << 2 AS x, y << 2 AS y, w << 2 AS w, h << 2 AS h FROM rects")
def prj19(spark, d):
    return P.rescale(V.rects(spark, d), 2)


@query("prj20", "rects", "SELECT img, id, greatest(x - 50, 0) AS x, greatest(y - 50, 0) AS y, least(w, 100 - greatest(x - 50, 0)) AS w, least(h, 100 - greatest(y - 50, 0)) AS h FROM rects")
def prj20(spark, d):
    moved = V.rects(spark, d).withColumn("x", F.col("x") - 50).withColumn("y", F.col("y") - 50)
    return P.clamp_rect(moved, 100, 100)


@query("prj21", "segments", "SELECT img, id, CAST(floor((((x1 + y2) % 360) + 22.5) % 360 / 45) + 1 AS BIGINT) AS code FROM segments")
def prj21(spark, d):
    return V.segments(spark, d).select("img", "id", P.direction((F.col("x1") + F.col("y2")) % 360).alias("code"))


@query("prj22", "segments", "SELECT img, id, (img * 2654435761) % 16777216 AS color FROM segments")
def prj22(spark, d):
    return V.segments(spark, d).select("img", "id", P.label_color(F.col("img")).alias("color"))


@query("prj24", "color", "SELECT img, y, x, 'b' AS channel, b AS v FROM color UNION ALL SELECT img, y, x, 'g', gr FROM color UNION ALL SELECT img, y, x, 'r', r FROM color")
def prj24(spark, d):
    return P.unpivot_channels(V.color(spark, d), {"b": "b", "g": "gr", "r": "r"})


@query("prj24_merge", "color", "SELECT img, y, x, b, gr AS g, r FROM color")
def prj24_merge(spark, d):
    return P.pivot_channels(prj24(spark, d), ["b", "g", "r"])
