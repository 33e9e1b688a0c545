"""Queries of aggregates, lookups and joins over pixels, regions and colours."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelattice import views as V
from pagelattice.operators import pointwise as P
from pagelattice.operators import regions as R
from pagelattice.plans.registry import query

PIX, c = ("img", "y", "x"), F.col
_R6 = "CAST(floor(({v}) * 1000000 + 0.5) AS BIGINT)"


def r6(v):
    return F.floor(v * 1e6 + 0.5).cast("long")


_SD = "sqrt(CAST(sum((b - mb) * (b - mb) + (gr - mg) * (gr - mg) + (r - mr) * (r - mr)) AS DOUBLE) / count(*))"


@query("agg1", "color", f", m AS (SELECT img, CAST(sum(b) AS BIGINT) // count(*) AS mb, CAST(sum(gr) AS BIGINT) // count(*) AS mg, CAST(sum(r) AS BIGINT) // count(*) AS mr FROM color GROUP BY img) SELECT img, mb AS mean_b, mg AS mean_g, mr AS mean_r, {_R6.format(v=_SD)} AS sd FROM color JOIN m USING (img) GROUP BY img, mb, mg, mr")
def agg1(spark, d):
    """Whole mean of every channel and the root mean squared distance from it."""
    px = V.color(spark, d)
    m = px.groupBy("img").agg(*[F.expr(f"sum({v}) div count(*)").alias(n) for v, n in (("b", "mean_b"), ("gr", "mean_g"), ("r", "mean_r"))])
    far = sum(((c(v) - c(n)) * (c(v) - c(n)) for v, n in (("b", "mean_b"), ("gr", "mean_g"), ("r", "mean_r"))), F.lit(0))
    return px.join(m, "img").groupBy("img", "mean_b", "mean_g", "mean_r").agg(r6(F.sqrt(F.sum(far) / F.count("*"))).alias("sd"))


_KEY = "((b * 119999 // 2550000) * 144 + (gr * 119999 // 2550000) * 12 + r * 119999 // 2550000)"
_HIST = f", h AS (SELECT img, key, count(*) AS cnt, row_number() OVER (PARTITION BY img ORDER BY count(*) DESC, key DESC) AS place FROM (SELECT img, {_KEY} AS key FROM color) GROUP BY img, key)"
_KEPT = ", tail AS (SELECT *, sum(cnt) OVER (PARTITION BY img ORDER BY place DESC ROWS UNBOUNDED PRECEDING) AS t, sum(cnt) OVER (PARTITION BY img) AS total, count(*) OVER (PARTITION BY img) AS n FROM h), kept AS (SELECT img, least(greatest(count(*) FILTER (WHERE t >= total * 0.05::DOUBLE), 10), 256, n) AS kept FROM tail GROUP BY img, n)"


@query("agg2", "color", _HIST + " SELECT img, key, cnt FROM h")
def agg2(spark, d):
    return R.histogram(V.color(spark, d)).select("img", "key", "cnt")


@query("win17", "color", _HIST + " SELECT img, key, cnt, place FROM h")
def win17(spark, d):
    return R.histogram(V.color(spark, d))


@query("win18", "color", _HIST + _KEPT + " SELECT img, kept FROM kept")
def win18(spark, d):
    return R.kept_colors(R.histogram(V.color(spark, d)))


@query("joi5", "color", _HIST + _KEPT + ", p AS (SELECT a.img, a.key, b.key AS near, b.place, (a.key // 144 - b.key // 144) * (a.key // 144 - b.key // 144) + (a.key // 12 % 12 - b.key // 12 % 12) * (a.key // 12 % 12 - b.key // 12 % 12) + (a.key % 12 - b.key % 12) * (a.key % 12 - b.key % 12) AS d FROM h a JOIN kept k ON a.img = k.img AND a.place > k.kept JOIN h b ON b.img = a.img AND b.place <= k.kept) SELECT img, key, near FROM (SELECT *, row_number() OVER (PARTITION BY img, key ORDER BY d, place) AS k FROM p) WHERE k = 1")
def joi5(spark, d):
    h = R.histogram(V.color(spark, d))
    return R.nearest_kept(h, R.kept_colors(h))


@query("agg3", "color", f"SELECT img, {_KEY} AS key, {_R6.format(v='avg(b)')} AS b, {_R6.format(v='avg(gr)')} AS gr, {_R6.format(v='avg(r)')} AS r FROM color GROUP BY ALL")
def agg3(spark, d):
    key = R.color_key(c("b"), c("gr"), c("r")).alias("key")
    return V.color(spark, d).groupBy("img", key).agg(*[r6(F.avg(v)).alias(v) for v in ("b", "gr", "r")])


_REG = ", reg AS (SELECT *, g // 64 AS label FROM gray)"


def _regions(spark, d):
    return R.level_regions(V.gray(spark, d))


@query("agg4", "gray", _REG + f", m AS (SELECT img, label, avg(x) AS mx, avg(y) AS my FROM reg GROUP BY ALL) SELECT img, label, count(*) AS n, {_R6.format(v='avg(x) / 64')} AS cx, {_R6.format(v='avg(y) / 64')} AS cy, {_R6.format(v='avg(abs(x - mx)) / 64')} AS adx, {_R6.format(v='avg(abs(y - my)) / 64')} AS ady FROM reg JOIN m USING (img, label) GROUP BY img, label")
def agg4(spark, d):
    """Size, centre and mean distance from the centre of every region, in shares of the side."""
    s = R.region_spread(_regions(spark, d))
    return s.select("img", "label", "n", r6(c("mx") / 64).alias("cx"), r6(c("my") / 64).alias("cy"), r6(c("adx") / 64).alias("adx"), r6(c("ady") / 64).alias("ady"))


@query("agg4_colors", "gray", _REG + " SELECT img, label, g // 8 AS color, count(*) AS n FROM reg GROUP BY ALL")
def agg4_colors(spark, d):
    """Colour frequencies of every region."""
    return _regions(spark, d).groupBy("img", "label", F.expr("g div 8").alias("color")).agg(F.count("*").alias("n"))


@query("agg5", "gray", _REG + ", m AS (SELECT img, label, CAST(sum(g) AS BIGINT) // count(*) AS s FROM reg GROUP BY ALL), e AS (SELECT img, min(s) AS lo, max(s) AS hi FROM m GROUP BY img) SELECT reg.img, reg.y, reg.x, CASE WHEN hi > lo THEN (s - lo) * 255 // (hi - lo) ELSE 0 END AS v FROM reg JOIN m USING (img, label) JOIN e ON e.img = reg.img")
def agg5(spark, d):
    """Mean score of every region, stretched and painted back."""
    px = _regions(spark, d)
    m = px.groupBy("img", "label").agg(F.expr("sum(g) div count(*)").alias("s"))
    return R.paint(px.select(*PIX, "label"), P.stretch(m, "s")).select(*PIX, "v")


@query("agg6", "color", f"SELECT img, {_KEY} AS key, {_R6.format(v='avg(gr)')} AS score FROM color GROUP BY ALL")
def agg6(spark, d):
    return V.color(spark, d).groupBy("img", R.color_key(c("b"), c("gr"), c("r")).alias("key")).agg(r6(F.avg("gr")).alias("score"))


@query("agg7", "gray", _REG + f", m AS (SELECT img, label, avg(x) AS mx, avg(y) AS my FROM reg GROUP BY ALL) SELECT img, label, {_R6.format(v='avg(abs(x - mx))')} AS mad_x, {_R6.format(v='avg(abs(y - my))')} AS mad_y FROM reg JOIN m USING (img, label) GROUP BY img, label")
def agg7(spark, d):
    return R.region_spread(_regions(spark, d)).select("img", "label", r6(c("adx")).alias("mad_x"), r6(c("ady")).alias("mad_y"))


_BANDS = "count(*) FILTER (WHERE y < 2) + count(*) FILTER (WHERE y >= 62) + count(*) FILTER (WHERE x < 2) + count(*) FILTER (WHERE x >= 62)"


@query("agg8", "gray", _REG + f" SELECT img, label, count(*) FILTER (WHERE y < 2) AS top, count(*) FILTER (WHERE y >= 62) AS bottom, count(*) FILTER (WHERE x < 2) AS left_, count(*) FILTER (WHERE x >= 62) AS right_ FROM reg GROUP BY img, label")
def agg8(spark, d):
    return _regions(spark, d).groupBy("img", "label").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("top", "y < 2"), ("bottom", "y >= 62"), ("left_", "x < 2"), ("right_", "x >= 62"))])


@query("sta7", "gray", _REG + f", m AS (SELECT img, label, avg(x) AS mx, avg(y) AS my FROM reg GROUP BY ALL), s AS (SELECT img, label, ({_BANDS}) / (1 + avg(abs(x - mx)) + avg(abs(y - my))) AS k FROM reg JOIN m USING (img, label) GROUP BY img, label) SELECT reg.img, reg.y, reg.x, floor(k * 1000000 + 0.5) > 4000000 AS ground FROM reg JOIN s USING (img, label)")
def sta7(spark, d):
    """Pixels whose region lies along the border more than its spread explains."""
    px = _regions(spark, d)
    m = px.groupBy("img", "label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    bands = sum((F.count_if(F.expr(e)) for e in ("y >= 62", "x < 2", "x >= 62")), F.count_if(F.expr("y < 2")))
    s = px.join(m, ["img", "label"]).groupBy("img", "label").agg((bands / (F.lit(1.0) + F.avg(F.abs(c("x") - c("mx"))) + F.avg(F.abs(c("y") - c("my"))))).alias("k"))
    return R.paint(px, s).select(*PIX, (F.floor(c("k") * 1e6 + 0.5) > 4000000).alias("ground"))


_POLY = [(10, 8), (58, 4), (60, 40), (6, 44)]
_CROSS = " AND ".join(f"({x2 - x1} * (y - {y1}) - ({y2 - y1}) * (x - {x1})) >= 0" for (x1, y1), (x2, y2) in zip(_POLY, _POLY[1:] + _POLY[:1]))


@query("agg14", "gray", f", s AS (SELECT img, count(*) FILTER (WHERE {_CROSS}) AS inside, count(*) FILTER (WHERE g > 160) AS salient, count(*) FILTER (WHERE g > 160 AND {_CROSS}) AS common, count(*) AS n FROM gray GROUP BY img) SELECT img, CASE WHEN salient * 10 >= n THEN {_R6.format(v='common / CAST(inside AS DOUBLE)')} ELSE 0 END AS p, CASE WHEN salient * 10 >= n THEN {_R6.format(v='common / CAST(salient AS DOUBLE)')} ELSE 0 END AS r FROM s")
def agg14(spark, d):
    """Precision and recall of a quadrangle against the salient pixels; 0 if fewer than a tenth are salient."""
    inside = R.in_polygon(c("x"), c("y"), [(F.lit(x), F.lit(y)) for x, y in _POLY])
    s = V.gray(spark, d).groupBy("img").agg(F.count_if(inside).alias("inside"), F.count_if(c("g") > 160).alias("salient"), F.count_if(inside & (c("g") > 160)).alias("both"), F.count("*").alias("n"))
    enough = c("salient") * 10 >= c("n")
    return s.select("img", F.when(enough, r6(c("both") / c("inside"))).otherwise(0).alias("p"), F.when(enough, r6(c("both") / c("salient"))).otherwise(0).alias("r"))


@query("agg15", "rects", "SELECT id, CASE WHEN w > 0 AND h > 0 THEN CAST(floor(CAST(w AS DOUBLE) / 100 * (CAST(h AS DOUBLE) / 100) * 200 / (CAST(w AS DOUBLE) / 100 + CAST(h AS DOUBLE) / 100) + 0.0001::DOUBLE) AS BIGINT) ELSE 0 END AS f1 FROM rects")
def agg15(spark, d):
    p, r = c("w") / 100, c("h") / 100
    return V.rects(spark, d).select("id", F.when((p > 0) & (r > 0), F.floor(p * r * 200 / (p + r) + 0.0001)).otherwise(0).cast("long").alias("f1"))


@query("agg16", "gray", "SELECT img, min(g) AS lo, max(g) AS hi FROM gray GROUP BY img")
def agg16(spark, d):
    return V.gray(spark, d).groupBy("img").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))


@query("agg17", "rects", "SELECT img, max(w) AS width, CAST(sum(h) AS BIGINT) AS height FROM rects GROUP BY img")
def agg17(spark, d):
    return V.rects(spark, d).groupBy("img").agg(F.max("w").alias("width"), F.sum("h").alias("height"))


@query("agg18", "color", f", s AS (SELECT img, 'b' AS ch, CAST(sum(abs(b - 128)) AS BIGINT) AS v FROM color GROUP BY img UNION ALL SELECT img, 'g', CAST(sum(abs(gr - 128)) AS BIGINT) FROM color GROUP BY img UNION ALL SELECT img, 'r', CAST(sum(abs(r - 128)) AS BIGINT) FROM color GROUP BY img) SELECT img, {_R6.format(v='avg(v)')} AS mean_level, max(v) AS max_level FROM s GROUP BY img")
def agg18(spark, d):
    """Mean and largest of a per-channel level."""
    px = P.unpivot_channels(V.color(spark, d), {"b": "b", "g": "gr", "r": "r"})
    s = px.groupBy("img", "channel").agg(F.sum(F.abs(c("v") - 128)).alias("v"))
    return s.groupBy("img").agg(r6(F.avg("v")).alias("mean_level"), F.max("v").alias("max_level"))


@query("agg19", "gray", "SELECT img, count(*) FILTER (WHERE g <> 0) AS n, count(*) FILTER (WHERE g > 160) AS m FROM gray GROUP BY img")
def agg19(spark, d):
    return V.gray(spark, d).groupBy("img").agg(F.count_if(c("g") != 0).alias("n"), F.count_if(c("g") > 160).alias("m"))


_SLOPE = "CAST(floor(CAST(y2 - y1 AS DOUBLE) / (x2 - x1) / 0.18::DOUBLE + 0.5) AS BIGINT)"


@query("agg21", "segments", f"SELECT img, {_SLOPE} AS bucket, count(*) AS votes FROM segments WHERE x1 <> x2 GROUP BY ALL")
def agg21(spark, d):
    """Votes of every slope bucket."""
    k = (c("y2") - c("y1")).cast("double") / (c("x2") - c("x1"))
    return V.segments(spark, d).where("x1 <> x2").groupBy("img", F.floor(k / 0.18 + 0.5).cast("long").alias("bucket")).agg(F.count("*").alias("votes"))


@query("srt11", "segments", f", v AS (SELECT img, {_SLOPE} AS bucket, count(*) AS votes FROM segments WHERE x1 <> x2 GROUP BY ALL) SELECT img, bucket, votes, place FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY votes DESC, bucket) AS place FROM v) WHERE place <= 2")
def srt11(spark, d):
    """The two largest slope clusters of an image."""
    w = Window.partitionBy("img").orderBy(F.desc("votes"), "bucket")
    return agg21(spark, d).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 2")


@query("agg22", "gray", _REG + " SELECT img, label, count(*) FILTER (WHERE (x + y) % 5 < 2) AS inside, count(*) AS n, count(*) FILTER (WHERE (x + y) % 5 < 2) * 10 > count(*) * 4 AS salient FROM reg GROUP BY img, label")
def agg22(spark, d):
    """Share of every segment that a mask covers, and whether it counts as salient."""
    inside = F.count_if((c("x") + c("y")) % 5 < 2)
    return _regions(spark, d).groupBy("img", "label").agg(inside.alias("inside"), F.count("*").alias("n"), (inside * 10 > F.count("*") * 4).alias("salient"))


@query("agg23", "color", ", u AS (SELECT 'b' AS channel, b AS v FROM color UNION ALL SELECT 'g', gr FROM color UNION ALL SELECT 'r', r FROM color) SELECT channel, v, count(*) AS n FROM u GROUP BY ALL")
def agg23(spark, d):
    return P.unpivot_channels(V.color(spark, d), {"b": "b", "g": "gr", "r": "r"}).groupBy("channel", "v").agg(F.count("*").alias("n"))


@query("agg24", "segments", f"SELECT img, {_R6.format(v='avg(CASE WHEN x1 < x2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS share FROM segments GROUP BY img")
def agg24(spark, d):
    return V.segments(spark, d).groupBy("img").agg(r6(F.avg((c("x1") < c("x2")).cast("double"))).alias("share"))


@query("flt13", "gray", "SELECT img, bool_or(g > 240) AS v FROM gray GROUP BY img")
def flt13(spark, d):
    return V.gray(spark, d).groupBy("img").agg(F.bool_or(c("g") > 240).alias("v"))


@query("flt18", "gray", "SELECT img, bool_or(CAST(g AS DOUBLE) / 255 > 0.9::DOUBLE) AS v FROM gray GROUP BY img")
def flt18(spark, d):
    return V.gray(spark, d).groupBy("img").agg(F.bool_or(c("g") / 255 > 0.9).alias("v"))


@query("flt19", "gray", "SELECT img, count(*) FILTER (WHERE g > 200) * 100 // count(*) <= 5 AS empty FROM gray GROUP BY img")
def flt19(spark, d):
    return V.gray(spark, d).groupBy("img").agg((F.expr("count_if(g > 200) * 100 div count(*)") <= 5).alias("empty"))


@query("flt20", "gray", "SELECT img FROM gray GROUP BY img HAVING count(*) FILTER (WHERE g > 160) * 10 >= count(*)")
def flt20(spark, d):
    return V.gray(spark, d).groupBy("img").agg(F.count_if(c("g") > 160).alias("k"), F.count("*").alias("n")).where("k * 10 >= n").select("img")


@query("flt21", "gray", "SELECT img, y, x, g BETWEEN 64 AND 192 AS inside, greatest(64, least(192, g)) AS bound FROM gray")
def flt21(spark, d):
    return V.gray(spark, d).select(*PIX, c("g").between(64, 192).alias("inside"), F.greatest(F.lit(64), F.least(F.lit(192), c("g"))).cast("long").alias("bound"))


@query("joi1", "gray", _REG + ", s AS (SELECT img, label, count(*) AS n FROM reg GROUP BY ALL) SELECT reg.img, reg.y, reg.x, n AS v FROM reg JOIN s USING (img, label)")
def joi1(spark, d):
    """A value of each label painted on its pixels."""
    px = _regions(spark, d)
    return R.paint(px, px.groupBy("img", "label").agg(F.count("*").alias("v"))).select(*PIX, "v")


_EDGES = " UNION ALL ".join(f"SELECT a.img, a.y * 64 + a.x AS a, b.y * 64 + b.x AS b, abs(a.g - b.g) AS w FROM gray a JOIN gray b ON a.img = b.img AND b.y = a.y + {dy} AND b.x = a.x + {dx}" for dy, dx in ((0, 1), (1, 0), (1, 1), (-1, 1)))


def _edges(spark, d):
    px = V.gray(spark, d)
    row, column = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    near = px.withColumn("r", F.lead("g").over(row)).withColumn("d", F.lead("g").over(column)).withColumn("dr", F.lead("r").over(column)).withColumn("ur", F.lag("r").over(column))
    at = lambda dy, dx, n: F.struct(((c("y") + dy) * 64 + c("x") + dx).alias("b"), F.abs(c("g") - c(n)).alias("w"))
    each = F.explode(F.array(at(0, 1, "r"), at(1, 0, "d"), at(1, 1, "dr"), at(-1, 1, "ur")))
    return near.select("img", (c("y") * 64 + c("x")).alias("a"), each.alias("e")).select("img", "a", "e.b", "e.w").where("w is not null")


@query("joi2", "gray", _EDGES)
def joi2(spark, d):
    """The pixel graph: right, down, down right and up right neighbours with their difference."""
    return _edges(spark, d)


@query("srt1", "gray", f", e AS ({_EDGES}) SELECT img, a, b, w, row_number() OVER (PARTITION BY img ORDER BY w, a, b) AS place FROM e")
def srt1(spark, d):
    return _edges(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("img").orderBy("w", "a", "b")).cast("long"))


_KEPT_COLORS = _HIST + _KEPT + ", t AS (SELECT h.img, h.key, h.cnt, k.kept FROM h JOIN kept k ON h.img = k.img AND h.place <= k.kept)"


def _kept_colors(spark, d):
    """(img, key, cnt, kept): the colours that stay after quantising, as many as ``kept``, 256 at most."""
    h = R.histogram(V.color(spark, d))
    return h.join(R.kept_colors(h), "img").where("place <= kept").select("img", "key", "cnt", "kept")


@query("joi3", "color", _KEPT_COLORS + " SELECT a.img, a.key AS a, b.key AS b, (a.key // 144 - b.key // 144) * (a.key // 144 - b.key // 144) + (a.key // 12 % 12 - b.key // 12 % 12) * (a.key // 12 % 12 - b.key // 12 % 12) + (a.key % 12 - b.key % 12) * (a.key % 12 - b.key % 12) AS d2 FROM t a JOIN t b ON a.img = b.img AND a.key < b.key")
def joi3(spark, d):
    """Distances between the colours that stay after quantising an image."""
    t = _kept_colors(spark, d)
    pairs = t.select("img", c("key").alias("a")).join(t.select("img", c("key").alias("b")), "img").where("a < b")
    part = lambda p: [F.expr(f"{p} div 144"), F.expr(f"{p} div 12 % 12"), F.expr(f"{p} % 12")]
    return pairs.withColumn("d2", sum(((x - y) * (x - y) for x, y in zip(part("a"), part("b"))), F.lit(0)).cast("long"))


@query("joi4", "gray", _REG + f", f AS (SELECT img, label, g // 8 AS color, count(*) AS k FROM reg GROUP BY ALL), r AS (SELECT img, label, count(*) AS n, avg(x) / 64 AS cx, avg(y) / 64 AS cy FROM reg GROUP BY ALL), k AS (SELECT a.img, a.label AS la, b.label AS lb, sum(a.k * b.k * abs(a.color - b.color)) AS s FROM f a JOIN f b ON a.img = b.img AND a.label <> b.label GROUP BY ALL) SELECT k.img, la AS label, {_R6.format(v='sum(CAST(s AS DOUBLE) / (ra.n * rb.n) * rb.n * exp(-((ra.cx - rb.cx) * (ra.cx - rb.cx) + (ra.cy - rb.cy) * (ra.cy - rb.cy)) / 0.4::DOUBLE)) / 100')} AS contrast FROM k JOIN r ra ON ra.img = k.img AND ra.label = la JOIN r rb ON rb.img = k.img AND rb.label = lb GROUP BY k.img, la")
def joi4(spark, d):
    """Region contrast: colour distances of region pairs weighted by size and damped by the distance of their centres."""
    px = _regions(spark, d)
    f = px.groupBy("img", "label", F.expr("g div 8").alias("color")).agg(F.count("*").alias("k"))
    r = px.groupBy("img", "label").agg(F.count("*").alias("n"), (F.avg("x") / 64).alias("cx"), (F.avg("y") / 64).alias("cy"))
    a = f.select("img", c("label").alias("la"), c("color").alias("ca"), c("k").alias("ka"))
    b = f.select("img", c("label").alias("lb"), c("color").alias("cb"), c("k").alias("kb"))
    k = a.join(b, "img").where("la <> lb").groupBy("img", "la", "lb").agg(F.sum(c("ka") * c("kb") * F.abs(c("ca") - c("cb"))).alias("s"))
    ra = r.select("img", c("label").alias("la"), c("n").alias("na"), c("cx").alias("xa"), c("cy").alias("ya"))
    rb = r.select("img", c("label").alias("lb"), c("n").alias("nb"), c("cx").alias("xb"), c("cy").alias("yb"))
    near = F.exp(-((c("xa") - c("xb")) * (c("xa") - c("xb")) + (c("ya") - c("yb")) * (c("ya") - c("yb"))) / 0.4)
    each = c("s").cast("double") / (c("na") * c("nb")) * c("nb") * near
    return k.join(ra, ["img", "la"]).join(rb, ["img", "lb"]).groupBy("img", c("la").alias("label")).agg(r6(F.sum(each) / 100).alias("contrast"))


@query("joi6", "color", _KEPT_COLORS + ", p AS (SELECT a.img, a.key AS a, b.key AS b, b.cnt, a.kept, row_number() OVER (PARTITION BY a.img, a.key ORDER BY (a.key // 144 - b.key // 144) * (a.key // 144 - b.key // 144) + (a.key // 12 % 12 - b.key // 12 % 12) * (a.key // 12 % 12 - b.key // 12 % 12) + (a.key % 12 - b.key % 12) * (a.key % 12 - b.key % 12), b.key) AS place FROM t a JOIN t b ON a.img = b.img) SELECT img, a AS key, CAST(sum(cnt) AS BIGINT) AS near FROM p WHERE place <= greatest((kept + 5) // 10, 2) GROUP BY img, a")
def joi6(spark, d):
    """Pixels of the nearest colours of each that stays after quantising: a tenth of them, rounded, two at least."""
    t = _kept_colors(spark, d)
    part = lambda p: [F.expr(f"{p} div 144"), F.expr(f"{p} div 12 % 12"), F.expr(f"{p} % 12")]
    p = t.select("img", c("key").alias("a")).join(t.select("img", c("key").alias("b"), "cnt", "kept"), "img")
    p = p.withColumn("d", sum(((x - y) * (x - y) for x, y in zip(part("a"), part("b"))), F.lit(0)))
    w = Window.partitionBy("img", "a").orderBy("d", "b")
    return p.withColumn("place", F.row_number().over(w)).where("place <= greatest((kept + 5) div 10, 2)").groupBy("img", c("a").alias("key")).agg(F.sum("cnt").alias("near"))


_LINE = "lines_ AS (SELECT a.img, a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, a.h AS ah, b.x AS bx, b.y AS by_ FROM rects a JOIN rects b ON a.img = b.img AND a.id < b.id AND abs(a.y - b.y) < 60 AND abs(a.x - b.x) < 120 AND abs(a.y - b.y) * 10 < 7 * abs(a.x - b.x))"
_SUP = ", sup AS (SELECT l.img, i, j, count(*) AS support FROM lines_ l JOIN rects k ON k.img = l.img AND abs((k.y - ay) * (bx - ax) - (by_ - ay) * (k.x - ax)) * 2 < ah * abs(bx - ax) GROUP BY ALL)"


def _support(spark, d):
    r = V.rects(spark, d)
    a = r.select("img", c("id").alias("i"), c("x").alias("ax"), c("y").alias("ay"), c("h").alias("ah"))
    b = r.select("img", c("id").alias("j"), c("x").alias("bx"), c("y").alias("by_"))
    seeds = a.join(b, "img").where("i < j and abs(ay - by_) < 60 and abs(ax - bx) < 120 and abs(ay - by_) * 10 < 7 * abs(ax - bx)")
    k = r.select("img", c("id").alias("k"), c("x").alias("kx"), c("y").alias("ky"))
    near = "abs((ky - ay) * (bx - ax) - (by_ - ay) * (kx - ax)) * 2 < ah * abs(bx - ax)"
    return seeds.join(k, "img").where(near)


@query("joi9", "rects", f", {_LINE}{_SUP} SELECT * FROM sup")
def joi9(spark, d):
    """Text-line seeds: pairs of components, and how many components lie along the line through them."""
    return _support(spark, d).groupBy("img", "i", "j").agg(F.count("*").alias("support"))


@query("joi12", "rects", f", {_LINE}{_SUP}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY support DESC, i, j) AS k FROM sup) WHERE k = 1) SELECT img, id FROM rects r WHERE NOT EXISTS (SELECT 1 FROM best b JOIN lines_ l ON l.img = b.img AND l.i = b.i AND l.j = b.j WHERE b.img = r.img AND abs((r.y - ay) * (bx - ax) - (by_ - ay) * (r.x - ax)) * 2 < ah * abs(bx - ax))")
def joi12(spark, d):
    """The components that the best-supported line of their image leaves for the next round."""
    s = _support(spark, d)
    count = s.groupBy("img", "i", "j").agg(F.count("*").alias("n"))
    best = count.groupBy("img").agg(F.max_by(F.struct("i", "j"), F.struct("n", -c("i"), -c("j"))).alias("p")).select("img", "p.i", "p.j")
    used = s.join(best, ["img", "i", "j"], "left_semi").select("img", c("k").alias("id"))
    return V.rects(spark, d).select("img", "id").join(used, ["img", "id"], "left_anti")


@query("flt4", "rects", f", s AS (SELECT a.img, a.id, sum(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE))) AS far FROM rects a JOIN rects b ON a.img = b.img GROUP BY a.img, a.id) SELECT img, id FROM (SELECT img, id, floor(far * 1000 + 0.5) AS f, max(floor(far * 1000 + 0.5)) OVER (PARTITION BY img) AS top FROM s) WHERE f * 10 < top * 9 OR top = 0")
def flt4(spark, d):
    """Components that are not far from all others of their image."""
    r = V.rects(spark, d)
    o = r.select("img", c("x").alias("ox"), c("y").alias("oy"))
    dist = F.sqrt(((c("x") - c("ox")) * (c("x") - c("ox")) + (c("y") - c("oy")) * (c("y") - c("oy"))).cast("double"))
    s = r.join(o, "img").groupBy("img", "id").agg(F.floor(F.sum(dist) * 1000 + 0.5).alias("f"))
    return s.join(s.groupBy("img").agg(F.max("f").alias("top")), "img").where("f * 10 < top * 9 or top = 0").select("img", "id")


@query("joi15", "gray", _REG + ", s AS (SELECT img, label, CAST(sum(g) AS BIGINT) // count(*) AS m, count(*) FILTER (WHERE (x + y) % 5 < 2) * 10 > count(*) * 4 AS salient FROM reg GROUP BY img, label) SELECT a.img, a.label AS la, b.label AS lb, a.m > b.m AS right_order FROM s a JOIN s b ON a.img = b.img WHERE a.salient AND NOT b.salient")
def joi15(spark, d):
    """Pairs of a salient and another segment, and whether their scores rank them rightly."""
    inside = F.count_if((c("x") + c("y")) % 5 < 2)
    s = _regions(spark, d).groupBy("img", "label").agg(F.expr("sum(g) div count(*)").alias("m"), (inside * 10 > F.count("*") * 4).alias("salient"))
    a = s.where("salient").select("img", c("label").alias("la"), c("m").alias("ma"))
    b = s.where("not salient").select("img", c("label").alias("lb"), c("m").alias("mb"))
    return a.join(b, "img").select("img", "la", "lb", (c("ma") > c("mb")).alias("right_order"))


@query("srt3", "segments", "SELECT img, id, place FROM (SELECT img, id, row_number() OVER (PARTITION BY img ORDER BY score DESC, id) AS place FROM segments) WHERE place <= 5000")
def srt3(spark, d):
    """The lines of an image by score, five thousand at most."""
    w = Window.partitionBy("img").orderBy(F.desc("score"), "id")
    return V.segments(spark, d).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5000").select("img", "id", "place")


@query("srt4", "rects", "SELECT img, id, place FROM (SELECT img, id, w, row_number() OVER (PARTITION BY img ORDER BY w DESC, id) AS place, max(w) OVER (PARTITION BY img) AS top FROM rects) WHERE (place <= 3 OR w * 3 > top * 2) AND place <= 8")
def srt4(spark, d):
    """The best candidates of an image: the first three, and more while they are near the best, up to eight."""
    w = Window.partitionBy("img").orderBy(F.desc("w"), "id")
    best = V.rects(spark, d).groupBy("img").agg(F.max("w").alias("top"))
    ranked = V.rects(spark, d).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 8")
    return ranked.join(best, "img").where("place <= 3 or w * 3 > top * 2").select("img", "id", "place")


@query("srt5", "rects", ", r AS (SELECT img, id, h, row_number() OVER (PARTITION BY img ORDER BY w DESC, id) AS line_rank, row_number() OVER (PARTITION BY img ORDER BY w * h DESC, id) AS space_rank FROM rects) SELECT img, id, line_rank, space_rank FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY space_rank * (100 + h), line_rank) AS k FROM r) WHERE k = 1")
def srt5(spark, d):
    """One candidate an image by fused ranks: space rank damped by tilt, then line rank."""
    w = lambda *o: Window.partitionBy("img").orderBy(*o)
    r = V.rects(spark, d).withColumn("line_rank", F.row_number().over(w(F.desc("w"), "id")).cast("long")).withColumn("space_rank", F.row_number().over(w(F.desc(c("w") * c("h")), "id")).cast("long"))
    best = F.min_by(F.struct("id", "line_rank", "space_rank"), F.struct(c("space_rank") * (c("h") + 100), c("line_rank"))).alias("b")
    return r.groupBy("img").agg(best).select("img", "b.id", "b.line_rank", "b.space_rank")


@query("srt8", "segments", "SELECT img, id, row_number() OVER (PARTITION BY img ORDER BY y1 + y2, id) AS place FROM segments")
def srt8(spark, d):
    return V.segments(spark, d).select("img", "id", F.row_number().over(Window.partitionBy("img").orderBy(c("y1") + c("y2"), "id")).cast("long").alias("place"))


@query("srt10", "segments", "SELECT img, id, row_number() OVER (PARTITION BY img ORDER BY (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) DESC, id) AS place FROM segments")
def srt10(spark, d):
    far = (c("x2") - c("x1")) * (c("x2") - c("x1")) + (c("y2") - c("y1")) * (c("y2") - c("y1"))
    return V.segments(spark, d).select("img", "id", F.row_number().over(Window.partitionBy("img").orderBy(F.desc(far), "id")).cast("long").alias("place"))


@query("srt2", "segments", "SELECT img, id, row_number() OVER (PARTITION BY img ORDER BY x1, y1, x2, y2, id) AS place FROM segments")
def srt2(spark, d):
    """Lexicographic order of the rows of an image."""
    return V.segments(spark, d).select("img", "id", F.row_number().over(Window.partitionBy("img").orderBy("x1", "y1", "x2", "y2", "id")).cast("long").alias("place"))


@query("srt12", "segments", "SELECT img, id FROM (SELECT img, id, row_number() OVER (PARTITION BY img ORDER BY score, id) AS k FROM segments) WHERE k % 3 = 1")
def srt12(spark, d):
    """A systematic sample: every third row of an image in order of score."""
    w = Window.partitionBy("img").orderBy("score", "id")
    return V.segments(spark, d).withColumn("k", F.row_number().over(w)).where("k % 3 = 1").select("img", "id")


@query("set1", "gray", "SELECT img, y, x FROM gray WHERE g > 96 INTERSECT SELECT img, y, x FROM gray WHERE g < 160")
def set1(spark, d):
    return V.mask(spark, d, 96).intersect(V.dark(spark, d, 160))


@query("set2", "mask dark", "SELECT img, y, x FROM mask UNION SELECT img, y, x FROM dark")
def set2(spark, d):
    return V.mask(spark, d).union(V.dark(spark, d)).distinct()


@query("set3", "gray", "SELECT img, y, x FROM gray WHERE g > 96 EXCEPT SELECT img, y, x FROM gray WHERE g > 160")
def set3(spark, d):
    return V.mask(spark, d, 96).join(V.mask(spark, d, 160), list(PIX), "left_anti")


@query("set4", "segments", ", r AS (SELECT img, id, score, 1 AS phase FROM segments WHERE score > 40 UNION ALL SELECT img, id, score, 2 FROM segments WHERE score > 25 UNION ALL SELECT img, id, score, 3 FROM segments WHERE score > 10) SELECT img, id, CAST(phase AS BIGINT) AS phase FROM (SELECT *, row_number() OVER (PARTITION BY img, phase ORDER BY score DESC, id) AS k FROM r) WHERE k <= 30")
def set4(spark, d):
    """Candidates of three phases, thirty of each at most, one after the other."""
    s = V.segments(spark, d)
    phases = [s.where(c("score") > t).select("img", "id", "score", F.lit(k).cast("long").alias("phase")) for k, t in ((1, 40), (2, 25), (3, 10))]
    every = phases[0].unionByName(phases[1]).unionByName(phases[2])
    w = Window.partitionBy("img", "phase").orderBy(F.desc("score"), "id")
    return every.withColumn("k", F.row_number().over(w)).where("k <= 30").select("img", "id", "phase")


@query("set5", "rects", "SELECT img, id, CAST(coalesce(sum(h) OVER (PARTITION BY img ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y, max(w) OVER (PARTITION BY img) - w AS margin FROM rects")
def set5(spark, d):
    """Pieces stacked from the top: where each begins, and the margin to the widest."""
    r = V.rects(spark, d)
    w = Window.partitionBy("img").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return r.join(r.groupBy("img").agg(F.max("w").alias("top")), "img").select("img", "id", F.coalesce(F.sum("h").over(w), F.lit(0)).cast("long").alias("y"), (c("top") - c("w")).alias("margin"))


@query("map1", "gray", _REG + " SELECT img, label, dense_rank() OVER (PARTITION BY img ORDER BY first_) AS place FROM (SELECT img, label, min(y * 64 + x) AS first_ FROM reg GROUP BY img, label)")
def map1(spark, d):
    """Labels numbered by first occurrence."""
    first = _regions(spark, d).groupBy("img", "label").agg(F.min(c("y") * 64 + c("x")).alias("f"))
    return first.select("img", "label", F.dense_rank().over(Window.partitionBy("img").orderBy("f")).cast("long").alias("place"))


#: Cosine and sine of 0, 10 ... 170 degrees in 1/1024 (rounded), so that engines agree.
_TRIG = [(k * 10, round(1024 * math.cos(k * math.pi / 18)), round(1024 * math.sin(k * math.pi / 18))) for k in range(18)]


@query("geo1", "mask", ", t(theta, co, si) AS (VALUES " + ", ".join(map(str, _TRIG)) + ") SELECT img, CAST(theta AS BIGINT) AS theta, CAST((x * co + y * si + 131072) // 4096 - 32 AS BIGINT) AS rho, count(*) AS votes FROM mask, t GROUP BY ALL")
def geo1(spark, d):
    """Hough votes: every mask pixel votes for the lines through it, eighteen directions, four pixels to a bucket."""
    table = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("theta"), F.lit(a).alias("co"), F.lit(b).alias("si")) for t, a, b in _TRIG])).alias("t")
    votes = V.mask(spark, d).select("img", "y", "x", table).selectExpr("img", "t.theta as theta", "(x * t.co + y * t.si + 131072) div 4096 - 32 as rho")
    return votes.groupBy("img", "theta", "rho").agg(F.count("*").alias("votes"))
