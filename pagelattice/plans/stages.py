"""Image stages: kernels over image rows, fused into one pass over the data, and pipelines made of them.

A stage maps one image to an image, a list of images, a number, a text or boxes. Adjacent
image stages are composed before they reach Spark, so a chain costs one exchange with the
Python workers. Nothing shuffles; batches are small since an image is large.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.kernels import border, filters, pages, regions, text
from pagelattice.schemas import BOXES, IMAGE_ROWS, PIECES, to_array, to_struct
from pagelattice.sources.images import IMAGE_TYPE, Config

Kernel = Callable[[np.ndarray], np.ndarray]


def gray_first(f: Kernel) -> Kernel:
    return lambda a: f(filters.to_gray(a))


#: Steps by name, as a configuration names them.
STEPS: dict[str, Kernel] = {
    "gray": filters.to_gray,
    "binarize": gray_first(pages.binarize),
    "denoise": gray_first(pages.salt_pepper_denoise),
    "gaussian": gray_first(pages.gaussian_denoise),
    "deskew": gray_first(pages.deskew),
    "cca": gray_first(pages.remove_garbage),
}


def step(name: str) -> Kernel:
    if name not in STEPS:
        raise KeyError(f"unknown step: {name}; known: {', '.join(sorted(STEPS))}")
    return STEPS[name]


def register(name: str, kernel: Kernel) -> None:
    STEPS[name] = kernel


def chain(*kernels: Kernel) -> Kernel:
    def run(a):
        for k in kernels:
            a = k(a)
        return a

    return run


def _batches(images: DataFrame, each: Callable[[int, dict], list[tuple]], schema: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [r for i, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if image is not None for r in each(i, image)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    return images.select("image_id", "image").mapInArrow(run, schema)


def map_images(images: DataFrame, *kernels: Kernel) -> DataFrame:
    """(image_id, image) after the kernels, fused into one pass; null images drop out."""
    f = chain(*kernels)
    return _batches(images, lambda i, im: [(i, to_struct(f(to_array(im)), im["origin"]))], IMAGE_ROWS, [("image_id", pa.int64()), ("image", IMAGE_TYPE)])


def explode_images(images: DataFrame, split: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(image_id, piece, image): the pieces of every image, numbered from 0."""
    return _batches(images, lambda i, im: [(i, k, to_struct(p, im["origin"])) for k, p in enumerate(split(to_array(im)))], PIECES, [("image_id", pa.int64()), ("piece", pa.int32()), ("image", IMAGE_TYPE)])


def boxes_of(images: DataFrame, find: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    return _batches(images, lambda i, im: [(i, k, *map(int, b)) for k, b in enumerate(find(to_array(im)))], BOXES, [("image_id", pa.int64()), *((n, pa.int32()) for n in ("piece", "x", "y", "w", "h"))])


def number_of(images: DataFrame, measure: Callable[[np.ndarray], float], name: str) -> DataFrame:
    return _batches(images, lambda i, im: [(i, float(measure(to_array(im))))], f"image_id long, {name} double", [("image_id", pa.int64()), (name, pa.float64())])


def text_of(images: DataFrame, recognizer: Callable[[np.ndarray], str] = text.recognize) -> DataFrame:
    """(image_id, text) by a pluggable recogniser of gray images."""
    return _batches(images, lambda i, im: [(i, recognizer(filters.to_gray(to_array(im))))], "image_id long, text string", [("image_id", pa.int64()), ("text", pa.string())])


def saliency(a: np.ndarray) -> np.ndarray:
    """The salient mask as black and white."""
    a = a if a.ndim == 3 else np.repeat(a[..., None], 3, 2)
    return regions.salient_mask(a)[0].astype(np.uint8) * 255


def segment(a: np.ndarray) -> np.ndarray:
    """Segments in fixed colours."""
    a = a if a.ndim == 3 else np.repeat(a[..., None], 3, 2)
    label = regions.salient_mask(a)[1].astype(np.uint64)
    color = (label * np.uint64(2654435761)) % np.uint64(1 << 24)
    return np.stack([(color >> np.uint64(s)) & np.uint64(255) for s in (16, 8, 0)], -1).astype(np.uint8)


def flatten_page(a: np.ndarray) -> np.ndarray:
    """The page in a photo, flattened; the photo itself where no outline is found."""
    three = a if a.ndim == 3 else np.repeat(a[..., None], 3, 2)
    corners = border.page_border(a, regions.salient_mask(three)[0])
    return a if corners is None else border.flatten(a, corners)


def show_border(a: np.ndarray) -> np.ndarray:
    """The photo with the outline drawn in red."""
    out = a.copy() if a.ndim == 3 else np.repeat(a[..., None], 3, 2)
    corners = border.page_border(a)
    if corners is not None:
        for k in range(4):
            filters.draw_line(out, tuple(np.rint([*corners[k], *corners[(k + 1) % 4]]).astype(int)), (0, 0, 255))
    return out


def text_pieces(a: np.ndarray) -> list[np.ndarray]:
    """A page as it is; of a photo the text regions, or the whole if there are none."""
    if text.page_kind(filters.to_gray(a)) >= 0:
        return [a]
    boxes = text.text_regions(a)
    return [a[y : y + h, x : x + w] for x, y, w, h in boxes if w > 1 and h > 1] or [a]


def stacked(pieces: DataFrame) -> DataFrame:
    """Pieces one below the other on white, in order; an image's pieces are one group."""

    def one(frame):
        import pandas as pd

        frame = frame.sort_values("piece")
        arrays = [filters.to_gray(to_array(im.asDict() if hasattr(im, "asDict") else im)) for im in frame["image"]]
        width = max(p.shape[1] for p in arrays)
        whole = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1])), constant_values=255) for p in arrays])
        first = frame["image"].iloc[0]
        return pd.DataFrame({"image_id": [frame["image_id"].iloc[0]], "image": [to_struct(whole, first["origin"])]})

    return pieces.groupBy("image_id").applyInPandas(one, IMAGE_ROWS)


def process_images(images: DataFrame) -> DataFrame:
    """The fixed pipeline in memory: flatten, find text, gray, binarise, denoise, deskew; (image_id, piece, image)."""
    clean = chain(*(step(n) for n in ("gray", "binarize", "denoise", "deskew")))
    return explode_images(images, lambda a: [clean(p) for p in text_pieces(flatten_page(a))])


class Pipeline:
    """Stages named by an ordered configuration: ``seg salient border turn text`` name sinks of the fixed part, the rest are steps in order."""

    FIXED = {"seg": segment, "salient": saliency, "border": show_border, "turn": flatten_page}

    def __init__(self, config: Config):
        config = Config(config.pairs)
        self.sinks = {k: config.take(k) for k in (*self.FIXED, "text")}
        self.steps = [(name, folder, step(name)) for name, folder in config.pairs]

    def outputs(self, images: DataFrame) -> dict[str, DataFrame]:
        """Every requested result by sink folder, lazily: fixed sinks, and the image after each step."""
        out = {folder: map_images(images, self.FIXED[k]) for k, folder in self.sinks.items() if folder and k != "text"}
        done: list[Kernel] = []
        for _, folder, kernel in self.steps:
            done.append(kernel)
            f = chain(*done)
            pieces = explode_images(images, lambda a, f=f: [f(p) for p in text_pieces(flatten_page(a))])
            if folder:
                out[folder] = stacked(pieces)
        return out

    def run(self, images: DataFrame, out: str, recognizer: Callable[[np.ndarray], str] | None = None) -> dict[str, str]:
        """Writes every output as Parquet under ``out``, and the recognised text if asked for; returns the paths."""
        paths = {}
        results = self.outputs(images)
        for folder, df in results.items():
            paths[folder] = f"{out}/{folder}"
            df.write.mode("overwrite").parquet(paths[folder])
        if recognizer is not None:
            last = images.sparkSession.read.parquet(paths[self.steps[-1][1]]) if self.steps and self.steps[-1][1] else images
            paths["text"] = f"{out}/{self.sinks['text'] or 'text'}"
            text_of(last, recognizer).write.mode("overwrite").parquet(paths["text"])
        return paths


#: The older fixed order of the clean-up steps, kept as a preset.
LEGACY = ("gray", "denoise", "binarize", "deskew", "binarize")


def legacy(images: DataFrame) -> DataFrame:
    return map_images(images, flatten_page, *(step(n) for n in LEGACY))


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows of the gray view, three times enlarged; assembled by row, so a task holds one image."""
    from pagelattice.views import gray

    rows = gray(spark, sf_dir).groupBy("img", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "g"))), lambda s: s["g"]).alias("r"))
    whole = rows.groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "r"))), lambda s: s["r"]).alias("rows"))

    def run(batches):
        for batch in batches:
            images = [to_struct(np.kron(np.array(r), np.ones((3, 3))), f"gray/{i}") for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, IMAGE_TYPE)], ["image_id", "image"])

    return whole.mapInArrow(run, IMAGE_ROWS)


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written in the built-in font: a benchmark item is an image, its words' letters that the font has."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("image_id"), F.upper("text").alias("t")).where("t is not null")

    def run(batches):
        for batch in batches:
            images = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = ["".join(ch for ch in w if ch in text.FONT) for w in t.split()]
                words = [w for w in words if w] or ["NO"]
                lines = [" ".join(words[k : k + 5]) for k in range(0, len(words), 5)]
                images.append(to_struct(text.render(lines), f"page/{i}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, IMAGE_TYPE)], ["image_id", "image"])

    # kernels cost far more than their rows weigh: a fixed number keeps adaptive execution from making one partition of them
    return items.repartition(4 * spark.sparkContext.defaultParallelism, "image_id").mapInArrow(run, IMAGE_ROWS)
