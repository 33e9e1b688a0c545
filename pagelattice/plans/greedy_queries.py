"""Queries of order-dependent merges and of kernels that have no image output."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pagelattice import views as V
from pagelattice.kernels import border, filters, pages, regions, text
from pagelattice.operators import components as C
from pagelattice.operators import geometry as G
from pagelattice.operators import greedy
from pagelattice.plans import neighbourhoods as N
from pagelattice.plans import stages as S
from pagelattice.plans.registry import ORACLE, QUERIES, query
from pagelattice.sources import codecs

c = F.col


@query("flt6")
def flt6(spark, d):
    return greedy.distinct_lines(V.polar_segments(spark, d))


@query("joi10")
def joi10(spark, d):
    return greedy.merged_boxes(V.rects(spark, d))


@query("joi10_pairs", "rects", "SELECT a.img, a.id AS aid, b.id AS bid FROM rects a JOIN rects b ON a.img = b.img AND a.id < b.id WHERE greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) * 10 > least(a.w * a.h, b.w * b.h) * 6")
def joi10_pairs(spark, d):
    """Boxes of an image that overlap by more than six tenths of the smaller."""
    p = G.paired(V.rects(spark, d), "x", "y", "w", "h")
    w = G.overlap(c("ax"), c("ax") + c("aw"), c("bx"), c("bx") + c("bw"))
    h = G.overlap(c("ay"), c("ay") + c("ah"), c("by"), c("by") + c("bh"))
    return p.where(w * h * 10 > F.least(c("aw") * c("ah"), c("bw") * c("bh")) * 6).select("img", "aid", "bid")


@query("joi11")
def joi11(spark, d):
    return greedy.segment_blocks(V.segments(spark, d))


@query("win16")
def win16(spark, d):
    return greedy.steady_bands(QUERIES["win15"](spark, d))


@query("agg21_exact")
def agg21_exact(spark, d):
    return greedy.slopes(V.segments(spark, d))


def _widths(spark, d):
    """Mean and squared mean of the level (as stroke width) of every component, in integers."""
    p = C.components(V.mask(spark, d), C.EIGHT).join(V.gray(spark, d), ["img", "y", "x"])
    return p.groupBy("img", "label").agg(F.count("*").alias("n"), F.sum(c("g") - 160).alias("s"), F.sum((c("g") - 160) * (c("g") - 160)).alias("q"))


def flt3(spark, d):
    """Components whose stroke width deviates by no more than half of its mean: n q - s^2 <= s^2 / 4."""
    return _widths(spark, d).where("(n * q - s * s) * 4 <= s * s").select("img", "label")


QUERIES["flt3"] = flt3
ORACLE["flt3"] = N.cc_sql("mask", "mask", "cc", True, ", w AS (SELECT cc.img, label, count(*) AS n, sum(g - 160) AS s, sum((g - 160) * (g - 160)) AS q FROM cc JOIN gray ON gray.img = cc.img AND gray.y * 64 + gray.x = cc.id GROUP BY cc.img, label) SELECT img, label FROM w WHERE (n * q - s * s) * 4 <= s * s")


@query("flt14")
def flt14(spark, d):
    """Support of the vertical middle line of every image by its edges; null where the line is too broken."""
    def measure(a):
        score = border.line_score(filters.canny(a, 100, 300), (a.shape[1] // 2, 0, a.shape[1] // 2, a.shape[0] - 1), 3, 1000)
        return -1.0 if score is None else score

    return S.number_of(S.gray_images(spark, d), measure, "score")


@query("geo10")
def geo10(spark, d):
    """Text lines of an image's boxes, greedily."""
    def find(a):
        return text.text_lines([p.box for p in text.components_of(a < 128)], a.shape)

    return S.boxes_of(S.page_images(spark, d), find)


@query("geo16")
def geo16(spark, d):
    """Text pieces of every page by its kind: their sizes."""
    out = S.explode_images(S.page_images(spark, d), S.text_pieces)
    return out.select("image_id", "piece", c("image.height").alias("height"), c("image.width").alias("width"))


@query("grf2")
def grf2(spark, d):
    """Number of segments of every image."""
    return S.number_of(S.gray_images(spark, d), lambda a: int(regions.graph_segments(a, 200, 40).max()) + 1, "segments")


@query("grf9")
def grf9(spark, d):
    """Share of an image that its centre reaches over bright pixels."""
    return S.number_of(S.gray_images(spark, d), lambda a: regions.flood_from(a > 96, [(a.shape[0] // 2, a.shape[1] // 2)]).mean(), "share")


ORACLE["grf9"] = V.with_views("gray").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + (
    ", bright AS MATERIALIZED (SELECT img, y, x FROM gray WHERE g > 96), ends AS MATERIALIZED (SELECT img, max(y) + 1 AS h FROM gray GROUP BY img), steps(dy, dx) AS (SELECT a, b FROM range(-1, 2) s(a), range(-1, 2) t(b)), "
    "reach AS (SELECT b.img, b.y, b.x FROM bright b JOIN ends USING (img) WHERE b.y = h * 3 // 2 // 3 AND b.x = 32 UNION SELECT b.img, b.y, b.x FROM reach r, steps o, bright b WHERE b.img = r.img AND b.y = r.y + o.dy AND b.x = r.x + o.dx) "
    "SELECT e.img AS image_id, CAST(count(r.y) AS DOUBLE) / (h * 64) AS share FROM ends e LEFT JOIN reach r USING (img) GROUP BY e.img, h"
)


@query("sta6")
def sta6(spark, d):
    """Mean saliency by colour alone, after equalisation."""
    return S.number_of(S.gray_images(spark, d), lambda a: round(float(regions.color_contrast(filters.equalize(a)[..., None].repeat(3, 2)).mean()), 6), "score")


@query("geo3")
def geo3(spark, d):
    """Number of page-like quadrangles over the three thresholds."""
    return S.number_of(S.gray_images(spark, d), lambda a: sum(len(border.quadrangles(a, t)) for t in border.PHASES), "quads")


@query("sta13_kernel")
def sta13_kernel(spark, d):
    """Ink share after the denoising kernel."""
    return S.number_of(S.gray_images(spark, d), lambda a: round(float((pages.salt_pepper_denoise(a) == 0).mean()), 6), "ink")


def _numbers(name, source, measure, sql=None):
    def run(spark, d):
        return S.number_of(source(spark, d), measure, "v")

    query(name, "gray" if sql else "", sql)(run)


def _three(a):
    return a if a.ndim == 3 else np.repeat(a[..., None], 3, 2)


def _tiny(a):
    """An enlarged image at the size it has in the table, pixel by pixel."""
    return a[1::3, 1::3]


def _trimap(a):
    h, w = a.shape[:2]
    t = np.full((h, w), 128, np.uint8)
    t[: h // 8], t[h * 3 // 8 : h * 5 // 8, w * 3 // 8 : w * 5 // 8] = 0, 255
    return t


def _grid_cut(a):
    h, w = a.shape
    one, two, weight = regions.grid_edges(a)
    edges = {(i, j): 256 - x for i, j, x in zip(one.tolist(), two.tolist(), weight.tolist())}
    edges |= {(j, i): x for (i, j), x in list(edges.items())}
    return round(regions.min_cut(edges, h * w, 0, h * w - 1)[0], 6)


def _joined(a):
    """Sets left when neighbours of equal band are joined."""
    band = (a // 64).ravel()
    sets = regions.DisjointSets(a.size)
    one, two, _ = regions.grid_edges(a)
    for p, q in zip(one[band[one] == band[two]].tolist(), two[band[one] == band[two]].tolist()):
        p, q = sets.find(p), sets.find(q)
        if p != q:
            sets.join(p, q)
    return len({sets.find(i) for i in range(a.size)})


def _ranked(a):
    x = _tiny(a).astype(float) / 255
    w = regions.rank_weights([(x[k], x[k + 1]) for k in range(len(x) - 1)], 5)
    return round(float(w.sum()), 6)


def _corners(a, mask=None):
    found = border.page_border(a, mask)
    return -1.0 if found is None else round(float(np.abs(found).sum()), 3)


_numbers("grf1", S.gray_images, lambda a: _joined(_tiny(a)))
_numbers("grf6", S.gray_images, lambda a: int(regions.reached_regions(a > 160).max()) + 1)
_numbers("grf11", S.gray_images, lambda a: _grid_cut(_tiny(a)))
_numbers("grf14", S.gray_images, lambda a: len(text.color_regions(_three(_tiny(a)))))
_numbers("grf15", S.gray_images, lambda a: round(sum(k[2] for k in text.keypoints(text.extremal_regions(a), a.shape[1])), 6))
_numbers("flt22", S.gray_images, lambda a: sum(len(r) for r in text.extremal_regions(a, text.RegionParams(variation=0.1))))
_numbers("flt15", S.gray_images, lambda a: border.real_quadrangle(filters.canny(a, 100, 300), np.array([[5, 5], [a.shape[1] - 6, 5], [a.shape[1] - 6, a.shape[0] - 6], [5, a.shape[0] - 6]], float)) or -1.0)
_numbers("geo7", S.gray_images, lambda a: _corners(a, a > 128))
_numbers("geo8", S.gray_images, lambda a: _corners(a))
_numbers("geo12", S.page_images, lambda a: float(text.page_kind(a)) * 10 + len(text.components_of(a < 128)) % 10)
_numbers("sta2", S.gray_images, lambda a: round(float(regions.gaussian_mixture(_three(_tiny(a)).reshape(-1, 3) + np.arange(3) * 0.5, 3)[0].max()), 6))
_numbers("sta3", S.gray_images, lambda a: round(float(regions.grab_cut(_three(_tiny(a)), _trimap(_tiny(a)), 2, 5.0).mean()), 6))
_numbers("sta4", S.gray_images, _ranked)
_numbers("arr1", S.gray_images, lambda a: round(float((filters.convolution_matrix(np.array([[-0.5, 0, 0.5]]), *_tiny(a).shape) @ _tiny(a).astype(float).ravel()).sum()), 6),
         "SELECT img AS image_id, CAST(sum(CASE WHEN x >= 62 THEN g WHEN x <= 1 THEN -g ELSE 0 END) AS DOUBLE) / 2 AS v FROM gray GROUP BY img")
_numbers("arr2", S.gray_images, lambda a: round(float(np.linalg.svd(_tiny(a).astype(float), compute_uv=False)[0]), 4))
#: Sums of the pixels after a round trip through a codec's bytes; the images are three times enlarged.
_SUM = "SELECT img AS image_id, CAST(sum(g) * 9 AS DOUBLE) AS v FROM gray GROUP BY img"
_numbers("src8", S.gray_images, lambda a: codecs.read_vlib(codecs.write_vlib(a)).sum(dtype=float), _SUM)
_numbers("snk1", S.gray_images, lambda a: codecs.read_png(codecs.write_png(a)).sum(dtype=float), _SUM)
_numbers("src2", S.gray_images, lambda a: filters.to_gray(_three(a)).mean(), "SELECT img AS image_id, CAST(sum(g) AS DOUBLE) / count(*) AS v FROM gray GROUP BY img")


@query("geo14")
def geo14(spark, d):
    """Size of the flattened text block of every page."""
    def flat(a):
        corners = border.text_outline([p.box for p in text.components_of(a < 128)], a.shape)
        return a if corners is None else border.flatten(a, corners)

    return S.map_images(S.page_images(spark, d), flat).select("image_id", c("image.height").alias("height"), c("image.width").alias("width"))


@query("prj23")
def prj23(spark, d):
    """Boxes of the components drawn over the page."""
    def draw(a):
        out = _three(a).copy()
        for p in text.components_of(a < 128):
            filters.draw_rect(out, *p.box, (0, 0, 255))
        return out

    return S.map_images(S.page_images(spark, d), draw).select("image_id", F.md5("image.data").alias("md5"))


@query("mth10", "", None)
def mth10(spark, d):
    """Gamma quantiles at the sizes of parts: the constant of a configuration, on the driver."""
    table = [(k, float(round(pages.gamma_quantile(0.95, k / 2, 2.0), 9))) for k in range(1, 60)]
    q = spark.createDataFrame(table, "p_size int, quantile double")
    return V.load(spark, d, "part").select("p_partkey", "p_size").join(F.broadcast(q), "p_size").select("p_partkey", "quantile")


@query("api6")
def api6(spark, d):
    """The older preset on rendered pages."""
    return S.legacy(S.page_images(spark, d)).select("image_id", c("image.height").alias("height"), F.md5("image.data").alias("md5"))


@query("ocr2")
def ocr2(spark, d):
    """Recognised text after the clean-up steps."""
    return S.text_of(S.map_images(S.page_images(spark, d), S.step("binarize"), S.step("deskew")))
