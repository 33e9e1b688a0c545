"""Queries over segments, lines, rectangles and quadrangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice import views as V
from pagelattice.operators import geometry as G
from pagelattice.operators import regions as R
from pagelattice.plans.registry import query

c = F.col
_F6 = "CAST(floor({v} * 1000000 + 0.5) AS BIGINT)"


def f6(v):
    return F.floor(v * 1e6 + 0.5).cast("long")


_VERT = "({a} BETWEEN 0 AND pi() / 4 OR {a} BETWEEN pi() * 3 / 4 AND pi() * 5 / 4 OR {a} BETWEEN pi() * 7 / 4 AND 2 * pi())"
_HORI = "({a} BETWEEN pi() / 4 AND pi() * 3 / 4 OR {a} BETWEEN pi() * 5 / 4 AND pi() * 7 / 4)"
_UP = "(abs({a} - 0.0::DOUBLE) < pi() / 24 OR abs({a} - pi()) < pi() / 24)"
_LEVEL = "(abs({a} - pi() / 2) < pi() / 36)"
_PERSP = "CASE WHEN ({a} BETWEEN 0 AND pi() / 2 AND {b} BETWEEN pi() / 2 AND pi()) OR ({b} BETWEEN 0 AND pi() / 2 AND {a} BETWEEN pi() / 2 AND pi()) THEN abs((pi() / 2 - least({a}, {b})) - (greatest({a}, {b}) - pi() / 2)) <= pi() / 10 ELSE abs({a} - {b}) < 0.05::DOUBLE END"
_Q1, _Q2, _Q4 = "{x} BETWEEN 0 AND pi() / 2", "{x} BETWEEN pi() / 2 AND pi()", "{x} BETWEEN pi() * 3 / 2 AND 2 * pi()"


def _upright_pair(a, b):
    q1, q2, q4 = (lambda x: _Q1.format(x=x)), (lambda x: _Q2.format(x=x)), (lambda x: _Q4.format(x=x))
    same = f"({q1(a)} AND {q1(b)} AND {a} < pi() / 15 AND {b} < pi() / 15) OR ({q4(a)} AND {q4(b)} AND 2 * pi() - {a} < pi() / 15 AND 2 * pi() - {b} < pi() / 15)"
    opposed = " OR ".join(f"({q2(x)} AND {q4(y)} AND pi() - {x} < pi() / 15 AND 2 * pi() - {y} < pi() / 15)" for x, y in ((a, b), (b, a)))
    mirrored = " OR ".join(f"({q1(x)} AND {q4(y)} AND abs({x} - (2 * pi() - {y})) < pi() / 25)" for x, y in ((a, b), (b, a)))
    return f"({same} OR {opposed} OR {mirrored})"


@query("flt7", "polar", f"SELECT img, id, {_VERT.format(a='angle')} AS vert, {_HORI.format(a='angle')} AS hori FROM polar")
def flt7(spark, d):
    return V.polar_segments(spark, d).select("img", "id", G.is_vertical(c("angle")).alias("vert"), G.is_horizontal(c("angle")).alias("hori"))


_PAIRS = "polar a JOIN polar b ON a.img = b.img AND a.id < b.id"


def _pairs(spark, d):
    return G.paired(V.polar_segments(spark, d), "angle", "rho", "x1", "y1", "x2", "y2")


@query(
    "flt8", "polar",
    f"SELECT a.img, a.id AS aid, b.id AS bid, {_UP.format(a='a.angle')} AS verti, {_LEVEL.format(a='a.angle')} AS horiz, {_PERSP.format(a='a.angle', b='b.angle')} AS persp, {_upright_pair('a.angle', 'b.angle')} AS upright, floor(a.angle / (pi() / 2)) = floor(b.angle / (pi() / 2)) AS same FROM {_PAIRS}",
)
def flt8(spark, d):
    a, b = c("aangle"), c("bangle")
    return _pairs(spark, d).select("img", "aid", "bid", G.upright(a).alias("verti"), G.level(a).alias("horiz"), G.perspective_pair(a, b).alias("persp"), G.upright_pair(a, b).alias("upright"), G.same_quadrant(a, b).alias("same"))


_Q = "FROM polar a JOIN polar b ON a.img = b.img AND b.id = a.id + 1 JOIN polar c ON a.img = c.img AND c.id = a.id + 2 JOIN polar d ON a.img = d.img AND d.id = a.id + 3"


def _four(spark, d, *cols):
    p = V.polar_segments(spark, d)
    out = p.select("img", "id", *[c(x).alias(f"a_{x}") for x in cols])
    for k, n in enumerate("bcd", 1):
        out = out.join(p.select("img", (c("id") - k).alias("id"), *[c(x).alias(f"{n}_{x}") for x in cols]), ["img", "id"])
    return out


@query(
    "flt9", "polar",
    f"SELECT a.img, a.id, CASE WHEN {_UP.format(a='a.angle')} AND {_UP.format(a='b.angle')} THEN {_PERSP.format(a='c.angle', b='d.angle')} WHEN {_UP.format(a='c.angle')} AND {_UP.format(a='d.angle')} THEN {_PERSP.format(a='a.angle', b='b.angle')} WHEN {_LEVEL.format(a='a.angle')} AND {_LEVEL.format(a='b.angle')} THEN {_upright_pair('c.angle', 'd.angle')} WHEN {_LEVEL.format(a='c.angle')} AND {_LEVEL.format(a='d.angle')} THEN {_upright_pair('a.angle', 'b.angle')} ELSE TRUE END AS v {_Q}",
)
def flt9(spark, d):
    return _four(spark, d, "angle").select("img", "id", G.like_rectangle(*[c(f"{n}_angle") for n in "abcd"]).alias("v"))


@query("flt10", "polar", "SELECT img, id FROM polar WHERE NOT (angle BETWEEN pi() / 3 AND 2 * pi() / 3 OR angle BETWEEN 4 * pi() / 3 AND 5 * pi() / 3 OR angle BETWEEN 0 AND pi() / 6 OR angle BETWEEN pi() * 11 / 6 AND 2 * pi())")
def flt10(spark, d):
    return V.polar_segments(spark, d).where(G.outside_frame_angles(c("angle"))).select("img", "id")


def _corners(spark, d):
    """Quadrangles whose corners are the first points of four consecutive segments."""
    return _four(spark, d, "x1", "y1", "angle")


def _sides(q):
    """Side lengths, diagonals and the four corner angles of a quadrangle."""
    p = [(c(f"{n}_x1"), c(f"{n}_y1")) for n in "abcd"]
    dist = lambda i, j: G.distance(*p[i], *p[j])
    q = G.computed(q, {f"d{i}{j}": dist(i, j) for i, j in ((0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3))})
    ang = lambda x, y, z: G.angle_between(c(x), c(y), c(z))
    return G.computed(q.where("d01 > 0 and d12 > 0 and d23 > 0 and d30 > 0"), {"g0": ang("d01", "d30", "d13"), "g1": ang("d01", "d12", "d02"), "g2": ang("d12", "d23", "d13"), "g3": ang("d23", "d30", "d02")})


_DIST = "sqrt(CAST(({p}.x1 - {q}.x1) * ({p}.x1 - {q}.x1) + ({p}.y1 - {q}.y1) * ({p}.y1 - {q}.y1) AS DOUBLE)) AS {n}"
_SIDES = f", sides AS (SELECT a.img, a.id, a.angle AS aa, b.angle AS ab, " + ", ".join(_DIST.format(p=p, q=q, n=n) for p, q, n in (("a", "b", "d01"), ("b", "c", "d12"), ("c", "d", "d23"), ("d", "a", "d30"), ("a", "c", "d02"), ("b", "d", "d13"))) + f" {_Q}), quads AS (SELECT *, " + ", ".join(f"acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({x} * {x} + {y} * {y} - {z} * {z}) / (2 * {x} * {y})))) AS {n}" for x, y, z, n in (("d01", "d30", "d13", "g0"), ("d01", "d12", "d02", "g1"), ("d12", "d23", "d13", "g2"), ("d23", "d30", "d02", "g3"))) + " FROM sides WHERE d01 > 0 AND d12 > 0 AND d23 > 0 AND d30 > 0) "
_ACUTE = " + ".join(f"CAST(g{k} < 1.047::DOUBLE AS BIGINT)" for k in range(4))
_TOVERT = "(CASE WHEN {a} <= pi() / 2 THEN {a} WHEN {a} <= pi() * 3 / 2 THEN abs({a} - pi()) ELSE 2 * pi() - {a} END)"
_TOHORI = "abs(pi() / 2 - " + _TOVERT + ")"


@query("flt12", "polar", _SIDES + f"SELECT img, id, {_ACUTE} AS n FROM quads")
def flt12(spark, d):
    q = _sides(_corners(spark, d))
    return q.select("img", "id", sum((c(f"g{k}") < 1.047).cast("long") for k in range(4)).alias("n"))


_RULES = (
    ("R1", "least(d01, d23) < 50"),
    ("R2", "greatest(d30, d12) > 2 * least(d01, d23)"),
    ("R3", "g0 < 1.396 and g3 < 1.396 and 2 * d12 < d30"),
    ("R4", "g1 < 1.571 and g2 < 1.571 and 2 * d30 < d12"),
    ("R5", "g0 < 1.571 and g1 < 1.571 and 2 * d23 < d01"),
    ("R6", "g2 < 1.571 and g3 < 1.571 and 2 * d01 < d23"),
)


@query(
    "flt11", "polar",
    _SIDES + "SELECT img, id, CASE " + " ".join(f"WHEN {r} THEN '{n}'" for n, r in _RULES).replace("1.396", "1.396::DOUBLE").replace("1.571", "1.571::DOUBLE")
    + f" WHEN {_ACUTE} = 1 THEN 'R7' WHEN abs({_TOHORI.format(a='aa')} - {_TOHORI.format(a='ab')}) > pi() / 18 THEN 'R8' ELSE 'ok' END AS reason FROM quads",
)
def flt11(spark, d):
    """Why a quadrangle is no page: the first rule that applies, else ok."""
    q = _sides(_corners(spark, d))
    acute = sum((c(f"g{k}") < 1.047).cast("long") for k in range(4))
    reason = F.expr("CASE " + " ".join(f"WHEN {r} THEN '{n}'" for n, r in _RULES).replace("1.396", "1.396D").replace("1.571", "1.571D") + " END")
    tilt = F.abs(G.to_horizontal(c("a_angle")) - G.to_horizontal(c("b_angle")))
    return q.select("img", "id", F.coalesce(reason, F.when(acute == 1, "R7").when(tilt > G.PI / 18, "R8").otherwise("ok")).alias("reason"))


@query("flt16", "segments", "SELECT a.img, a.id AS aid, b.id AS bid, (a.x2 - a.x1) * (a.x2 - a.x1) + (a.y2 - a.y1) * (a.y2 - a.y1) AS len2, (abs(a.x1 - b.x1) < 60 AND abs(a.y1 - b.y1) < 60) OR (abs(a.x2 - b.x2) < 60 AND abs(a.y2 - b.y2) < 60) AS closes FROM segments a JOIN segments b ON a.img = b.img AND a.id < b.id")
def flt16(spark, d):
    s = G.paired(V.segments(spark, d), "x1", "y1", "x2", "y2")
    near = lambda k: (F.abs(c(f"ax{k}") - c(f"bx{k}")) < 60) & (F.abs(c(f"ay{k}") - c(f"by{k}")) < 60)
    return s.select("img", "aid", "bid", G.squared_length(p="a").alias("len2"), (near(1) | near(2)).alias("closes"))


@query("geo2", "polar", f"SELECT img, id, {_F6.format(v='rho')} AS rho, {_F6.format(v='angle')} AS angle, {_F6.format(v='(score + sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) / 5)')} AS s FROM polar")
def geo2(spark, d):
    p = V.polar_segments(spark, d)
    return p.select("img", "id", f6(c("rho")).alias("rho"), f6(c("angle")).alias("angle"), f6(c("score") + F.sqrt(G.squared_length().cast("double")) / 5).alias("s"))


@query("geo9", "rects", "SELECT a.img, a.id AS aid, b.id AS bid, CAST(floor(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / CAST(least(a.w * a.h, b.w * b.h) AS DOUBLE) * 1000000 + 0.5) AS BIGINT) AS ratio FROM rects a JOIN rects b ON a.img = b.img AND a.id < b.id")
def geo9(spark, d):
    return G.paired(V.rects(spark, d), "x", "y", "w", "h").select("img", "aid", "bid", f6(G.rect_overlap_ratio()).alias("ratio"))


_IN = "({x} > a.x AND {x} < a.x + a.w AND {y} > a.y AND {y} < a.y + a.h)"


@query("flt5", "rects", f"SELECT a.img, a.id AS aid, b.id AS bid, {_IN.format(x='b.x', y='b.y')} AS corner, " + " OR ".join(_IN.format(x=f"b.x + {i} * b.w", y=f"b.y + {j} * b.h") for i in (0, 1) for j in (0, 1)) + " AS meets FROM rects a JOIN rects b ON a.img = b.img AND a.id < b.id")
def flt5(spark, d):
    r = G.paired(V.rects(spark, d), "x", "y", "w", "h")
    inside = lambda x, y: (x > c("ax")) & (x < c("ax") + c("aw")) & (y > c("ay")) & (y < c("ay") + c("ah"))
    corners = [(c("bx") + i * c("bw"), c("by") + j * c("bh")) for i in (0, 1) for j in (0, 1)]
    v = inside(*corners[0])
    for x, y in corners[1:]:
        v = v | inside(x, y)
    return r.select("img", "aid", "bid", inside(*corners[0]).alias("corner"), v.alias("meets"))


@query("mth11", "segments", "SELECT a.img, a.id AS aid, b.id AS bid, greatest(0, least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) - greatest(least(a.x1, a.x2), least(b.x1, b.x2))) AS v FROM segments a JOIN segments b ON a.img = b.img AND a.id < b.id")
def mth11(spark, d):
    lo, hi = (lambda p: F.least(f"{p}x1", f"{p}x2")), (lambda p: F.greatest(f"{p}x1", f"{p}x2"))
    s = G.paired(V.segments(spark, d), "x1", "x2")
    return s.select("img", "aid", "bid", G.overlap(lo("a"), hi("a"), lo("b"), hi("b")).alias("v"))


_D = "CAST((a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2) AS DOUBLE)"
_MEET = "CASE WHEN " + _D + " <> 0 THEN CAST(floor((CAST((a.x1 * a.y2 - a.y1 * a.x2) * (b.{k}1 - b.{k}2) AS DOUBLE) - CAST((a.{k}1 - a.{k}2) * (b.x1 * b.y2 - b.y1 * b.x2) AS DOUBLE)) / " + _D + " * 1000 + 0.5) AS BIGINT) END AS {k}"


@query("mth7", "segments", f"SELECT a.img, a.id AS aid, b.id AS bid, {_MEET.format(k='x')}, {_MEET.format(k='y')} FROM segments a JOIN segments b ON a.img = b.img AND a.id < b.id")
def mth7(spark, d):
    s = G.paired(V.segments(spark, d), "x1", "y1", "x2", "y2")
    x, y = G.meeting_point("a", "b")
    return s.select("img", "aid", "bid", F.floor(x * 1000 + 0.5).cast("long").alias("x"), F.floor(y * 1000 + 0.5).cast("long").alias("y"))


@query("mth3", "segments", f"SELECT img, id, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS d2, {_F6.format(v='sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))')} AS d FROM segments")
def mth3(spark, d):
    return V.segments(spark, d).select("img", "id", G.squared_length().alias("d2"), f6(G.distance(c("x1"), c("y1"), c("x2"), c("y2"))).alias("d"))


@query("mth4", "polar", _SIDES + f"SELECT img, id, {_F6.format(v='g0')} AS g0, {_F6.format(v='g1')} AS g1, {_F6.format(v='g2')} AS g2, {_F6.format(v='g3')} AS g3 FROM quads")
def mth4(spark, d):
    return _sides(_corners(spark, d)).select("img", "id", *[f6(c(f"g{k}")).alias(f"g{k}") for k in range(4)])


@query("mth5", "segments", "SELECT img, id, x1 * x2 + y1 * y2 AS dot, x1 * y2 - x2 * y1 AS cross_ FROM segments")
def mth5(spark, d):
    return V.segments(spark, d).select("img", "id", (c("x1") * c("x2") + c("y1") * c("y2")).alias("dot"), (c("x1") * c("y2") - c("x2") * c("y1")).alias("cross_"))


@query("mth6", "polar", f"SELECT img, id, {_F6.format(v=_TOVERT.format(a='angle'))} AS vert, {_F6.format(v=_TOHORI.format(a='angle'))} AS hori FROM polar")
def mth6(spark, d):
    return V.polar_segments(spark, d).select("img", "id", f6(G.to_vertical(c("angle"))).alias("vert"), f6(G.to_horizontal(c("angle"))).alias("hori"))


@query("mth8", "segments", f"SELECT a.img, a.id AS aid, b.id AS bid, CASE WHEN a.x1 <> a.x2 OR a.y1 <> a.y2 THEN {_F6.format(v='(abs((a.x2 - a.x1) * (a.y1 - b.y1) - (a.x1 - b.x1) * (a.y2 - a.y1)) / sqrt(CAST((a.x2 - a.x1) * (a.x2 - a.x1) + (a.y2 - a.y1) * (a.y2 - a.y1) AS DOUBLE)))')} END AS v FROM segments a JOIN segments b ON a.img = b.img AND a.id < b.id")
def mth8(spark, d):
    s = G.paired(V.segments(spark, d), "x1", "y1", "x2", "y2")
    cross = F.abs((c("ax2") - c("ax1")) * (c("ay1") - c("by1")) - (c("ax1") - c("bx1")) * (c("ay2") - c("ay1")))
    len2 = G.squared_length(p="a")
    return s.select("img", "aid", "bid", F.when(len2 > 0, f6(cross / F.sqrt(len2.cast("double")))).alias("v"))


_SIDE = "({p}.rho / (cos({p}.angle) + sin({p}.angle) * 500 / 500) - 0.5 * 500)"
_ANTI = "abs(a.angle - b.angle) BETWEEN pi() * 0.75 AND pi() * 1.25"
_APART = f"(CASE WHEN {_ANTI} THEN a.rho + b.rho ELSE abs(a.rho - b.rho) END)"
_OPP = f"({_ANTI} OR ((abs(a.angle - b.angle) <= pi() * 0.25 OR abs(a.angle - b.angle) BETWEEN 1.75 * pi() AND 2 * pi()) AND {_SIDE.format(p='a')} * {_SIDE.format(p='b')} < 0)) AND {_APART} > 10"


@query("joi7", "polar", f"SELECT a.img, a.id AS aid, b.id AS bid FROM {_PAIRS} WHERE {_OPP}")
def joi7(spark, d):
    return _pairs(spark, d).where(G.opposite_sides(500, 500)).select("img", "aid", "bid")


_HP = f"hp AS (SELECT a.img, a.id AS aid, b.id AS bid FROM {_PAIRS} WHERE {_OPP} AND {_HORI.format(a='a.angle')} AND {_HORI.format(a='b.angle')})"
_VP = f"vp AS (SELECT a.img, a.id AS aid, b.id AS bid FROM {_PAIRS} WHERE {_OPP} AND {_VERT.format(a='a.angle')} AND {_VERT.format(a='b.angle')})"


@query("joi8", "polar", f", {_HP}, {_VP} SELECT hp.img, hp.aid AS h1, hp.bid AS h2, vp.aid AS v1, vp.bid AS v2 FROM hp JOIN vp ON hp.img = vp.img WHERE hp.aid <> vp.aid AND hp.aid <> vp.bid AND hp.bid <> vp.aid AND hp.bid <> vp.bid")
def joi8(spark, d):
    """Quadrangle candidates of an image: opposite level sides with opposite upright sides."""
    p = _pairs(spark, d).where(G.opposite_sides(500, 500))
    h = p.where(G.is_horizontal(c("aangle")) & G.is_horizontal(c("bangle"))).select("img", c("aid").alias("h1"), c("bid").alias("h2"))
    v = p.where(G.is_vertical(c("aangle")) & G.is_vertical(c("bangle"))).select("img", c("aid").alias("v1"), c("bid").alias("v2"))
    return h.join(v, "img").where("h1 <> v1 and h1 <> v2 and h2 <> v1 and h2 <> v2")


@query("geo13", "segments", "SELECT img, id, CAST(floor(y1 + CAST(y2 - y1 AS DOUBLE) / (x2 - x1) * (0 - x1) + 0.5) AS BIGINT) AS y_left, CAST(floor(y1 + CAST(y2 - y1 AS DOUBLE) / (x2 - x1) * (499 - x1) + 0.5) AS BIGINT) AS y_right FROM segments WHERE x1 <> x2")
def geo13(spark, d):
    s = V.segments(spark, d).where("x1 <> x2")
    at = lambda x: F.floor(c("y1") + (c("y2") - c("y1")).cast("double") / (c("x2") - c("x1")) * (x - c("x1")) + 0.5).cast("long")
    return s.select("img", "id", at(0).alias("y_left"), at(499).alias("y_right"))


@query("geo11", "segments", f", k AS (SELECT img, id, CASE WHEN x1 <> x2 THEN CAST(y2 - y1 AS DOUBLE) / (x2 - x1) END AS k FROM segments) SELECT img, {_F6.format(v='(max(k) FILTER (WHERE id = 1))')} AS first_k, {_F6.format(v='avg(k)')} AS mean_k FROM k GROUP BY img")
def geo11(spark, d):
    """Slope of the first segment and the mean slope of every image, added up in the order of the rows."""
    k = F.when(c("x1") != c("x2"), (c("y2") - c("y1")).cast("double") / (c("x2") - c("x1")))
    s = V.segments(spark, d, V.stored_at().alias("at")).withColumn("k", k)
    slopes = F.sort_array(F.collect_list(F.when(c("k").isNotNull(), F.struct("at", "k"))))
    one = s.groupBy("img").agg(F.max(F.when(c("id") == 1, c("k"))).alias("first"), slopes.alias("slopes"))
    return one.select("img", f6(c("first")).alias("first_k"), f6(R.mean_in_order(c("slopes"), lambda p: p["k"])).alias("mean_k"))


_PTS = "pts AS (SELECT img, id, 0 AS k, x1 AS x, y1 AS y FROM segments UNION ALL SELECT img, id, 1, x2, y2 FROM segments UNION ALL SELECT img, id, 2, x1, y2 FROM segments UNION ALL SELECT img, id, 3, x2, y1 + 7 FROM segments)"


@query("srt9", "segments", f", {_PTS}, s AS (SELECT *, y * 4 < sum(y) OVER (PARTITION BY img, id) AS up FROM pts), g AS (SELECT img, id, list_sort(list({{'x': x, 'y': y}}) FILTER (WHERE up)) AS u, list_sort(list({{'x': x, 'y': y}}) FILTER (WHERE NOT up)) AS d FROM s GROUP BY img, id) SELECT img, id, u[1].x AS tl_x, u[1].y AS tl_y, u[2].x AS tr_x, u[2].y AS tr_y, d[2].x AS br_x, d[2].y AS br_y, d[1].x AS bl_x, d[1].y AS bl_y FROM g WHERE len(u) = 2 AND len(d) = 2")
def srt9(spark, d):
    s = V.segments(spark, d)
    pts = s.select("img", "id", F.expr("stack(4, x1, y1, x2, y2, x1, y2, x2, y1 + 7) as (x, y)"))
    return G.ordered_corners(pts)
