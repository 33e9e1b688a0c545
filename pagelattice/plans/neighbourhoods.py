"""Queries over neighbourhoods, components and blobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelattice import views as V
from pagelattice.operators import components as C
from pagelattice.operators import neighbourhood as N
from pagelattice.plans.registry import ORACLE, QUERIES, query

PIX, c = ("img", "y", "x"), F.col
_ROW, _COL = "PARTITION BY img, y ORDER BY x", "PARTITION BY img, x ORDER BY y"
_BOX = (
    ", rows5 AS (SELECT img, y, x, g, sum(g) OVER w AS s, sum(g * g) OVER w AS q, count(*) OVER w AS n FROM gray WINDOW w AS (" + _ROW + " ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), "
    "box AS (SELECT img, y, x, g, CAST(sum(s) OVER w AS BIGINT) AS s, CAST(sum(q) OVER w AS BIGINT) AS q, sum(n) OVER w AS n FROM rows5 WINDOW w AS (" + _COL + " ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) "
)


@query("win1", "gray", _BOX + "SELECT img, y, x, s, q FROM box WHERE n = 25")
def win1(spark, d):
    return N.box_sums(V.gray(spark, d), "g", 2).where("s is not null").select(*PIX, "s", "q")


@query("win2", "gray", f", r AS (SELECT img, y, x, sum(g) OVER ({_ROW} ROWS UNBOUNDED PRECEDING) AS s FROM gray) SELECT img, y, x, CAST(sum(s) OVER ({_COL} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM r")
def win2(spark, d):
    return N.integral(V.gray(spark, d), "g").select(*PIX, "total")


_STAT = "st AS (SELECT img, y, x, g, CAST(s AS DOUBLE) / 25 AS m, sqrt(greatest(0.0::DOUBLE, (CAST(q AS DOUBLE) - CAST(s * s AS DOUBLE) / 25) / 25)) AS sd FROM box WHERE n = 25)"
_TH = {
    "win3": ("wolf", "m + (sd / max(sd) OVER w - 1) * 0.5 * (m - min(g) OVER w)"),
    "win3_niblack": ("niblack", "m + sd * 0.5"),
    "win3_sauvola": ("sauvola", "m * ((sd / 128 - 1) * 0.5 + 1)"),
}


def _threshold(rule):
    def run(spark, d):
        th = N.local_threshold(V.gray(spark, d), "g", 2, rule)
        return th.select(*PIX, F.when(c("g") >= F.floor(c("th") * 1000 + 0.5) / 1000, 255).otherwise(0).cast("long").alias("v"))

    return run


for _name, (_rule, _sql) in _TH.items():
    query(_name, "gray", _BOX.rstrip() + f", {_STAT}, th AS (SELECT img, y, x, g, {_sql} AS th FROM st WINDOW w AS (PARTITION BY img)) SELECT img, y, x, CAST(CASE WHEN g >= floor(th * 1000 + 0.5) / 1000 THEN 255 ELSE 0 END AS BIGINT) AS v FROM th")(_threshold(_rule))


@query("win5", "", "SELECT p_partkey AS id, CAST(floor((CASE WHEN l < 1 THEN 3.5::DOUBLE WHEN l < 1.5 THEN l ELSE (l - 1.6::DOUBLE) / 1.4::DOUBLE * 14 + 1 END) * 1000000 + 0.5) AS BIGINT) AS v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 12 AS l FROM part)")
def win5(spark, d):
    level = (c("p_size") / 12).cast("double")
    return V.load(spark, d, "part").select(c("p_partkey").cast("long").alias("id"), F.floor(N.window_divisor(level) * 1e6 + 0.5).cast("long").alias("v"))


@query("win6", "gray", f", h AS (SELECT img, y, x, lag(g, 1) OVER w + g * 2 + lead(g, 1) OVER w AS h FROM gray WINDOW w AS ({_ROW})), v AS (SELECT img, y, x, (lag(h, 1) OVER w + h * 2 + lead(h, 1) OVER w + 8) // 16 AS v FROM h WINDOW w AS ({_COL})) SELECT img, y, x, v FROM v WHERE v IS NOT NULL")
def win6(spark, d):
    return N.smooth(V.gray(spark, d), "g", (1, 2, 1)).where("v is not null").select(*PIX, "v")


@query("win7", "gray", f", h AS (SELECT img, y, x, lag(g, 2) OVER w + lag(g, 1) OVER w * 4 + g * 6 + lead(g, 1) OVER w * 4 + lead(g, 2) OVER w AS h FROM gray WINDOW w AS ({_ROW})), v AS (SELECT img, y, x, (lag(h, 2) OVER w + lag(h, 1) OVER w * 4 + h * 6 + lead(h, 1) OVER w * 4 + lead(h, 2) OVER w + 128) // 256 AS v FROM h WINDOW w AS ({_COL})) SELECT img, y, x, v FROM v WHERE v IS NOT NULL")
def win7(spark, d):
    return N.smooth(V.gray(spark, d), "g", (1, 4, 6, 4, 1)).where("v is not null").select(*PIX, "v")


_SOBEL = f", dm AS (SELECT img, y, x, lead(g) OVER w - lag(g) OVER w AS d, lag(g) OVER w + 2 * g + lead(g) OVER w AS m FROM gray WINDOW w AS ({_ROW})), sob AS (SELECT img, y, x, lag(d) OVER w + 2 * d + lead(d) OVER w AS gx, lead(m) OVER w - lag(m) OVER w AS gy FROM dm WINDOW w AS ({_COL}))"


@query("win8", "gray", _SOBEL + " SELECT img, y, x, gx, gy FROM sob WHERE gx IS NOT NULL AND gy IS NOT NULL")
def win8(spark, d):
    return N.sobel(V.gray(spark, d), "g").where("gx is not null and gy is not null").select(*PIX, "gx", "gy")


@query("win9", "gray", f"SELECT img, y, x, coalesce(lead(g) OVER w, g) - coalesce(lag(g) OVER w, g) AS v2 FROM gray WINDOW w AS ({_ROW})")
def win9(spark, d):
    return N.gradient(V.gray(spark, d), "g").select(*PIX, "v2")


_RING_SQL = f", r1 AS (SELECT img, y, x, g, lag(g) OVER w AS l, lead(g) OVER w AS r FROM gray WINDOW w AS ({_ROW})), ring AS (SELECT img, y, x, g, lag(l) OVER w AS n0, lag(g) OVER w AS n1, lag(r) OVER w AS n2, r AS n3, lead(r) OVER w AS n4, lead(g) OVER w AS n5, lead(l) OVER w AS n6, l AS n7 FROM r1 WINDOW w AS ({_COL}))"
_SUM8 = " + ".join(f"n{k}" for k in range(8))


@query("win10", "gray", _RING_SQL + f" SELECT img, y, x, g + {_SUM8} AS patch_sum, g * 9 + " + " + ".join(f"n{k} * {k + 1}" for k in range(8)) + f" AS patch_hash FROM ring WHERE {_SUM8} IS NOT NULL")
def win10(spark, d):
    """The 3 x 3 patch of every interior pixel, as its sum and a weighted sum of its places."""
    r = N.ring(V.gray(spark, d), "g")
    total = sum((c(f"n{k}") for k in range(8)), F.col("g"))
    weighted = sum((c(f"n{k}") * (k + 1) for k in range(8)), F.col("g") * 9)
    return r.select(*PIX, total.alias("patch_sum"), weighted.alias("patch_hash")).where("patch_sum is not null")


@query("win11", "gray", _RING_SQL + " SELECT img, y, x, CAST(" + " + ".join(f"CASE WHEN n{k} <> 0 AND n{k} < g THEN {1 << k} ELSE 0 END" for k in range(8)) + " AS BIGINT) AS code FROM ring")
def win11(spark, d):
    return N.lower_code(V.gray(spark, d), "g").select(*PIX, "code")


@query("arr3", "gray", _RING_SQL + " SELECT img, y, x, CAST(y + dy AS BIGINT) AS ny, CAST(x + dx AS BIGINT) AS nx FROM (" + " UNION ALL ".join(f"SELECT img, y, x, {dy} AS dy, {dx} AS dx FROM ring WHERE n{k} <> 0 AND n{k} < g" for k, (dy, dx) in enumerate(N.RING)) + ")")
def arr3(spark, d):
    """Neighbour codes as points: one row for each set bit."""
    code = N.lower_code(V.gray(spark, d), "g")
    steps = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(N.RING)])
    hit = F.explode(F.filter(steps, lambda s: c("code").bitwiseAND(s["bit"].cast("long")) != 0)).alias("s")
    return code.select(*PIX, hit).select(*PIX, (c("y") + c("s.dy")).cast("long").alias("ny"), (c("x") + c("s.dx")).cast("long").alias("nx"))


@query("win12", "gray mask", _SOBEL + ", t AS (SELECT s.img, s.y, s.x, sign(gx) AS dx, sign(gy) AS dy FROM sob s JOIN mask m ON s.img = m.img AND s.y = m.y AND s.x = m.x WHERE gx IS NOT NULL AND gy IS NOT NULL) SELECT img, CAST(y + dy AS BIGINT) AS y, CAST(x + dx AS BIGINT) AS x FROM t UNION SELECT img, y, x FROM mask")
def win12(spark, d):
    """Every edge pixel also sets the neighbour its gradient points to."""
    s = N.sobel(V.gray(spark, d), "g").where("gx is not null and gy is not null and g > 160")
    grown = s.select("img", (c("y") + F.signum("gy")).cast("long").alias("y"), (c("x") + F.signum("gx")).cast("long").alias("x"))
    return grown.union(V.mask(spark, d)).distinct()


@query("win13", "gray", f", h AS (SELECT img, y, x, min(g) OVER w AS lo, max(g) OVER w AS hi FROM gray WINDOW w AS ({_ROW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT img, y, x, min(lo) OVER w AS lo, max(hi) OVER w AS hi FROM h WINDOW w AS ({_COL} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def win13(spark, d):
    return N.extreme(V.gray(spark, d), "g", 1).select(*PIX, "lo", "hi")


_RUNS = "coalesce(list_max([length(w) FOR w IN regexp_extract_all(line, '{p}')]), 0)"


@query("win14", "lines", f"SELECT doc, y, CAST({_RUNS.format(p='[^ ]+')} AS BIGINT) AS longest_run, CAST({_RUNS.format(p=' +')} AS BIGINT) AS longest_gap FROM lines")
def win14(spark, d):
    """Longest run of ink and of blanks in every text line."""
    longest = lambda p: F.coalesce(F.array_max(F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(0)), F.length)), F.lit(0)).cast("long")
    return V.lines(spark, d).select("doc", "y", longest("[^ ]+").alias("longest_run"), longest(" +").alias("longest_gap"))


@query("win15", "lines", "SELECT doc, y // 20 AS band, CAST(min(length(line) - length(ltrim(line, ' '))) AS BIGINT) AS min_x, CAST(max(length(rtrim(line, ' '))) - 1 AS BIGINT) AS max_x FROM lines WHERE trim(line, ' ') <> '' GROUP BY doc, y // 20")
def win15(spark, d):
    """First and last ink of every band of twenty text lines."""
    ink = V.lines(spark, d).where(F.trim("line") != "")
    return ink.groupBy("doc", F.expr("y div 20").alias("band")).agg(F.min(F.length("line") - F.length(F.ltrim("line"))).cast("long").alias("min_x"), (F.max(F.length(F.rtrim("line"))) - 1).cast("long").alias("max_x"))


@query("agg20", "gray", ", t AS (SELECT img, y // 3 AS ty, x // 3 AS tx, count(*) FILTER (WHERE g > 128) AS white, count(*) AS n FROM gray GROUP BY ALL) SELECT g.img, g.y, g.x, CAST(CASE WHEN n = 9 THEN CASE WHEN white * 2 > n THEN 255 ELSE 0 END ELSE g END AS BIGINT) AS v FROM gray g JOIN t ON g.img = t.img AND g.y // 3 = t.ty AND g.x // 3 = t.tx")
def agg20(spark, d):
    return N.majority_tiles(V.gray(spark, d), "g").select(*PIX, "v")


@query("sta13", "gray", ", b AS (SELECT img, y, x, CASE WHEN g > 128 THEN 255 ELSE 0 END AS g FROM gray), t AS (SELECT img, y // 3 AS ty, x // 3 AS tx, count(*) FILTER (WHERE g > 128) AS white, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT b.img, b.y, b.x, CASE WHEN n = 9 THEN CASE WHEN white * 2 > n THEN 255 ELSE 0 END ELSE g END AS g FROM b JOIN t ON b.img = t.img AND b.y // 3 = t.ty AND b.x // 3 = t.tx), "
       f"h AS (SELECT img, y, x, lag(g, 1) OVER w + g * 2 + lead(g, 1) OVER w AS h FROM m WINDOW w AS ({_ROW})), v AS (SELECT img, y, x, (lag(h, 1) OVER w + h * 2 + lead(h, 1) OVER w + 8) // 16 AS v FROM h WINDOW w AS ({_COL})) SELECT img, y, x, CAST(CASE WHEN v > 128 THEN 255 ELSE 0 END AS BIGINT) AS v FROM v WHERE v IS NOT NULL")
def sta13(spark, d):
    """Salt-and-pepper denoising: threshold, tile majority, blur, threshold."""
    b = V.gray(spark, d).withColumn("g", F.when(F.col("g") > 128, 255).otherwise(0).cast("long"))
    m = N.majority_tiles(b, "g").select(*PIX, c("v").alias("g"))
    return N.smooth(m, "g", (1, 2, 1)).where("v is not null").select(*PIX, F.when(c("v") > 128, 255).otherwise(0).cast("long").alias("v"))


def _cc(source: str, name: str, eight: bool, width: int = 64) -> str:
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (eight or not dy or not dx)]
    edges = " UNION ALL ".join(f"SELECT a.img, a.y * {width} + a.x AS a, b.y * {width} + b.x AS b FROM {source} a JOIN {source} b ON a.img = b.img AND b.y = a.y + ({dy}) AND b.x = a.x + ({dx})" for dy, dx in steps)
    return (
        f"{name}_e AS MATERIALIZED ({edges}), {name}(img, id, label) USING KEY (img, id) AS (SELECT img, y * {width} + x, y * {width} + x FROM {source} "
        f"UNION SELECT e.img, e.a, min(n.label) FROM {name} n JOIN {name}_e e ON n.img = e.img AND n.id = e.b JOIN recurring.{name} o ON o.img = e.img AND o.id = e.a WHERE n.label < o.label GROUP BY e.img, e.a)"
    )


def cc_sql(views: str, source: str, name: str, eight: bool, more: str) -> str:
    """Oracle text with the components of ``source`` as CTE ``name`` (img, id, label)."""
    return V.with_views(*views.split()).replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _cc(source, name, eight) + more


def _grf(name, eight, more=""):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = cc_sql("mask", "mask", "cc", eight, more)
        return f

    return add


@_grf("grf4", False, " SELECT img, id // 64 AS y, id % 64 AS x, label FROM cc")
def grf4(spark, d):
    return C.components(V.mask(spark, d), C.FOUR)


@_grf("grf5", True, " SELECT img, id // 64 AS y, id % 64 AS x, label FROM cc WHERE (img, label) IN (SELECT (img, label) FROM cc GROUP BY img, label HAVING count(*) > 1)")
def grf5(spark, d):
    """Components over eight neighbours without the isolated pixels."""
    found = C.components(V.mask(spark, d), C.EIGHT)
    several = found.groupBy("img", "label").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(several, ["img", "label"], "left_semi").select(*PIX, "label")


_BLOB = ", blob AS (SELECT img, label, min(id // 64) AS top, max(id // 64) AS bottom, min(id % 64) AS left_, max(id % 64) AS right_, count(*) AS n FROM cc GROUP BY img, label)"


@_grf("agg9", True, _BLOB + " SELECT * FROM blob")
def agg9(spark, d):
    return C.blobs(C.components(V.mask(spark, d), C.EIGHT))


@_grf("agg10", True, _BLOB + " SELECT img, label, (bottom - top + 1) * (right_ - left_ + 1) AS area, CAST(floor(CAST(right_ - left_ + 1 AS DOUBLE) / (bottom - top + 1) * 1000000 + 0.5) AS BIGINT) AS aspect, CAST(floor(CAST(n AS DOUBLE) / ((bottom - top + 1) * (right_ - left_ + 1)) * 1000000 + 0.5) AS BIGINT) AS content FROM blob")
def agg10(spark, d):
    b = agg9(spark, d)
    h, w = c("bottom") - c("top") + 1, c("right_") - c("left_") + 1
    return b.select("img", "label", (h * w).alias("area"), F.floor(w / h * 1e6 + 0.5).cast("long").alias("aspect"), F.floor(c("n") / (h * w) * 1e6 + 0.5).cast("long").alias("content"))


_KEPT = _BLOB + ", cnt AS (SELECT img, count(*) AS blobs FROM blob GROUP BY img), kept AS (SELECT blob.* FROM blob JOIN cnt USING (img) WHERE (bottom - top + 1) * (right_ - left_ + 1) >= 25 AND (bottom - top + 1) * (right_ - left_ + 1) <= greatest(CASE WHEN blobs >= 40 THEN (64 // (blobs // 40)) * (64 // (blobs // 40)) ELSE 0 END, 36) AND right_ - left_ + 1 <= 20 * (bottom - top + 1) AND bottom - top + 1 <= 20 * (right_ - left_ + 1) AND n * 10 >= (bottom - top + 1) * (right_ - left_ + 1))"


@_grf("flt1", True, _KEPT + " SELECT * FROM kept")
def flt1(spark, d):
    return C.not_garbage(agg9(spark, d)).select("img", "label", "top", "bottom", "left_", "right_", "n")


@_grf("joi14", True, _KEPT + " SELECT img, id // 64 AS y, id % 64 AS x FROM cc WHERE (img, label) IN (SELECT (img, label) FROM kept)")
def joi14(spark, d):
    """The pixels of the blobs that are kept."""
    return C.components(V.mask(spark, d), C.EIGHT).join(flt1(spark, d), ["img", "label"], "left_semi").select(*PIX)


@_grf("sta12", True, _KEPT + ", k AS (SELECT img, id FROM cc WHERE (img, label) IN (SELECT (img, label) FROM kept)) SELECT g.img, g.y, g.x, CAST(CASE WHEN k.id IS NULL THEN 255 ELSE 0 END AS BIGINT) AS v FROM gray g LEFT JOIN k ON k.img = g.img AND k.id = g.y * 64 + g.x")
def sta12(spark, d):
    """Ink (0) of the kept blobs on white."""
    ink = joi14(spark, d).withColumn("v", F.lit(0).cast("long"))
    return V.gray(spark, d).select(*PIX).join(ink, list(PIX), "left").select(*PIX, F.coalesce("v", F.lit(255)).cast("long").alias("v"))


_MOM = ", s AS (SELECT img, label, count(*) AS n, sum(id // 64) AS sy, sum(id % 64) AS sx, sum((id // 64) * (id // 64)) AS syy, sum((id % 64) * (id % 64)) AS sxx, sum((id // 64) * (id % 64)) AS sxy FROM cc GROUP BY img, label), m AS (SELECT img, label, n, sx, sy, CAST(n * sxx - sx * sx AS DOUBLE) AS a, CAST(n * syy - sy * sy AS DOUBLE) AS b, CAST(n * sxy - sx * sy AS DOUBLE) AS e FROM s)"
_ECC = "CASE WHEN a + b > 0 THEN CAST(floor(sqrt(greatest(0.0::DOUBLE, 1 - (a + b - sqrt((a - b) * (a - b) + 4 * e * e)) / (a + b + sqrt((a - b) * (a - b) + 4 * e * e)))) * 10000 + 0.5) AS BIGINT) ELSE 0 END"


def _moments(spark, d):
    p = C.components(V.mask(spark, d), C.EIGHT)
    s = p.groupBy("img", "label").agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(n) for n, e in (("sy", "y"), ("sx", "x"), ("syy", "y * y"), ("sxx", "x * x"), ("sxy", "x * y"))])
    s = s.selectExpr("img", "label", "n", "sx", "sy", "cast(n * sxx - sx * sx as double) as a", "cast(n * syy - sy * sy as double) as b", "cast(n * sxy - sx * sy as double) as e")
    root = F.sqrt((c("a") - c("b")) * (c("a") - c("b")) + c("e") * c("e") * 4)
    ecc = F.sqrt(F.greatest(F.lit(0.0), 1 - (c("a") + c("b") - root) / (c("a") + c("b") + root)))
    return s.withColumn("ecc", F.when(c("a") + c("b") > 0, F.floor(ecc * 10000 + 0.5).cast("long")).otherwise(0))


@_grf("agg11", True, _MOM + f" SELECT img, label, n, CAST(floor(CAST(sx AS DOUBLE) / n * 10000 + 0.5) AS BIGINT) AS cx, CAST(floor(CAST(sy AS DOUBLE) / n * 10000 + 0.5) AS BIGINT) AS cy, {_ECC} AS ecc FROM m")
def agg11(spark, d):
    """Area, centroid and eccentricity of every component, from its moments."""
    return _moments(spark, d).select("img", "label", "n", F.floor(c("sx") / c("n") * 10000 + 0.5).cast("long").alias("cx"), F.floor(c("sy") / c("n") * 10000 + 0.5).cast("long").alias("cy"), "ecc")


@_grf("flt2", True, _MOM + f" SELECT img, label FROM m WHERE n BETWEEN 5 AND 400 AND {_ECC} BETWEEN 1000 AND 9950")
def flt2(spark, d):
    """Components of fitting area and eccentricity."""
    return _moments(spark, d).where("n between 5 and 400 and ecc between 1000 and 9950").select("img", "label")


@_grf("agg12", True, _BLOB + " SELECT img, label, CAST(floor(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY img) * 1000000 + 0.5) AS BIGINT) AS share FROM blob")
def agg12(spark, d):
    b = agg9(spark, d)
    total = b.groupBy("img").agg(F.sum("n").alias("total"))
    return b.join(total, "img").select("img", "label", F.floor(c("n") / c("total") * 1e6 + 0.5).cast("long").alias("share"))


@_grf("agg13", True, _BLOB + " SELECT img, CAST(4096 - max(n * 4096 + 4095 - label) % 4096 - 1 AS BIGINT) AS label, max(n) AS n FROM blob GROUP BY img")
def agg13(spark, d):
    """The largest component of each image; the first of equals."""
    return agg9(spark, d).groupBy("img").agg(F.max_by("label", F.struct("n", -c("label"))).alias("label"), F.max("n").alias("n"))


@_grf("srt6", True, _BLOB + " SELECT img, label, n, row_number() OVER (PARTITION BY img ORDER BY n DESC, label) AS place FROM blob")
def srt6(spark, d):
    return agg9(spark, d).select("img", "label", "n", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("n"), "label")).cast("long").alias("place"))


@_grf("srt7", False, _BLOB + " SELECT img, label, dense_rank() OVER (PARTITION BY img ORDER BY n DESC) AS place FROM blob")
def srt7(spark, d):
    return C.blobs(grf4(spark, d)).select("img", "label", F.dense_rank().over(Window.partitionBy("img").orderBy(F.desc("n"))).cast("long").alias("place"))


@_grf("grf7", False, _BLOB + " SELECT img, label, n FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY img) AS total FROM blob) WHERE k = 1 AND n * 50 > total")
def grf7(spark, d):
    """The largest region if it has more than two hundredths of the mask."""
    b = C.blobs(grf4(spark, d))
    return b.groupBy("img").agg(F.max_by("label", F.struct("n", -c("label"))).alias("label"), F.max("n").alias("n"), F.sum("n").alias("total")).where("n * 50 > total").select("img", "label", "n")


def _ends(spark, d):
    return V.gray(spark, d).groupBy("img").agg(F.max("y").alias("h"))


@_grf("joi13", True, ", ends AS (SELECT img, max(y) AS h FROM gray GROUP BY img) SELECT img, id // 64 AS y, id % 64 AS x FROM cc WHERE (img, label) NOT IN (SELECT (img, label) FROM cc JOIN ends USING (img) WHERE id // 64 = 0 OR id // 64 = h OR id % 64 = 0 OR id % 64 = 63)")
def joi13(spark, d):
    """Pixels of the components that don't touch the image's edge."""
    found = C.components(V.mask(spark, d), C.EIGHT)
    outer = found.join(_ends(spark, d), "img").where("y = 0 or y = h or x = 0 or x = 63").select("img", "label").distinct()
    return found.join(outer, ["img", "label"], "left_anti").select(*PIX)


@query("grf8", "")
def grf8(spark, d):
    """Holes filled: what the background cannot reach from the edge."""
    bright = V.gray(spark, d).where(F.col("g") > 96).select(*PIX)
    return C.border_flooded(bright, V.gray(spark, d).select(*PIX))


ORACLE["grf8"] = cc_sql("gray", "ground", "bg", True, ", ends AS (SELECT img, max(y) AS h FROM gray GROUP BY img), outer_ AS (SELECT DISTINCT img, label FROM bg JOIN ends USING (img) WHERE id // 64 = 0 OR id // 64 = h OR id % 64 = 0 OR id % 64 = 63) SELECT img, y, x FROM gray WHERE (img, y * 64 + x) NOT IN (SELECT (img, id) FROM bg WHERE (img, label) IN (SELECT (img, label) FROM outer_))").replace(", bg_e AS", ", ground AS (SELECT img, y, x FROM gray WHERE g <= 96), bg_e AS", 1)


def flagship(spark, d):
    """Wolf's threshold, components of the ink, blob statistics and the garbage filter, summed by image."""
    th = N.local_threshold(V.gray(spark, d), "g", 2, "wolf")
    ink = th.where("g < th").select(*PIX)
    kept = C.not_garbage(C.blobs(C.components(ink, C.EIGHT)))
    return kept.groupBy("img").agg(F.count("*").alias("blobs"), F.sum("n").alias("pixels"))


query("flagship")(flagship)
