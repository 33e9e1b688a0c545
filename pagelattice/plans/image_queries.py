"""Queries of image stages: kernels that SQL cannot express, checked by tests and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelattice.functions.text import error_rate
from pagelattice.kernels import filters, pages, regions, text
from pagelattice.plans import stages as S
from pagelattice.plans.registry import query


def _summary(images):
    """Size and a checksum of every image."""
    return images.select("image_id", F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.md5("image.data").alias("md5"))


def _stage(name, *kernels, source=S.gray_images):
    def run(spark, d):
        return _summary(S.map_images(source(spark, d), *kernels))

    query(name)(run)


_stage("stage_binarize", S.step("binarize"))
_stage("win4", lambda a: pages.binarize(a, "wolf", level=1.2))
_stage("sta14", lambda a: pages.binarize(a, "sauvola", level=1.0))
_stage("stage_denoise", S.step("denoise"))
_stage("stage_deskew", S.step("deskew"), source=S.page_images)
_stage("geo17", lambda a: pages.deskew(filters.rotate(a, 5, 255).astype("uint8")), source=S.page_images)
_stage("stage_cca", S.step("cca"))
_stage("win19", lambda a: filters.pyramid(a, 100)[0])
_stage("win20", lambda a: filters.shrink_to(a, 100)[0])
_stage("win21", lambda a: filters.canny(a, 100, 300) * 255)
_stage("win22", lambda a: filters.distance(a > 160) * 8)
_stage("grf3", S.segment)
_stage("sta9", S.saliency)
_stage("sta5", lambda a: regions.region_contrast(a[..., None].repeat(3, 2), regions.graph_segments(a, 200, 60)) * 255)
_stage("sta8", lambda a: regions.cut_region(a / 255.0, (a // 64).astype(int)) * 255)
_stage("grf10", lambda a: text.stroke_width(a > 140) * 10)
_stage("grf16", lambda a: text.extremal_mask(a) * 255)
_stage("sta10", lambda a: text.text_components(a)[0] * 255, source=S.page_images)
_stage("geo5", S.flatten_page)
_stage("geo4", S.show_border)
_stage("syn1_gauss", lambda a: pages.add_gaussian(a, 12, 1))
_stage("syn1_pepper", lambda a: pages.add_salt_pepper(a, 0.05, 2))
_stage("syn1_ground", lambda a: pages.blend_background(a, pages.random_polygons(*a.shape[:2], 8, 3)))
_stage("syn1_rotate", lambda a: filters.rotate(a, 7, 255))


@query("sta1")
def sta1(spark, d):
    """Noise level of every image."""
    return S.number_of(S.gray_images(spark, d), lambda a: round(pages.noise_level(a), 6), "level")


@query("grf13")
def grf13(spark, d):
    """Stable dark regions of every image: their number."""
    return S.number_of(S.gray_images(spark, d), lambda a: len(text.extremal_regions(a)), "regions")


@query("sta11")
def sta11(spark, d):
    """Boxes of the text lines."""
    return S.boxes_of(S.page_images(spark, d), text.text_regions)


@query("geo15")
def geo15(spark, d):
    return S.number_of(S.page_images(spark, d), lambda a: text.page_kind(filters.to_gray(a)), "kind")


@query("api2")
def api2(spark, d):
    """The whole fixed pipeline on rendered pages."""
    out = S.process_images(S.page_images(spark, d))
    return out.select("image_id", "piece", F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.md5("image.data").alias("md5"))


@query("ocr1")
def ocr1(spark, d):
    """Recognised text of the rendered pages."""
    return S.text_of(S.page_images(spark, d))


@query("eva1_pages")
def eva1_pages(spark, d):
    """Character error rate of the recogniser on the rendered pages, noise added."""
    clean = S.text_of(S.page_images(spark, d)).withColumnRenamed("text", "truth")
    noisy = S.text_of(S.map_images(S.page_images(spark, d), lambda a: pages.add_salt_pepper(a, 0.01, 3), S.step("denoise")))
    return clean.join(noisy, "image_id").select("image_id", F.round(error_rate(F.col("truth"), F.col("text")), 6).alias("cer"))
