"""Connected components of pixel relations: a union-find kernel for each image, one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUR = ((0, 1), (1, 0))
#: Bit k of a neighbour code is the pixel at this (dy, dx).
RING = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
EIGHT = ((0, 1), (1, 0), (1, 1), (1, -1))


def label_pixels(y: np.ndarray, x: np.ndarray, steps=FOUR) -> np.ndarray:
    """For each pixel the index of the first pixel (in row order) of its component.

    Labels fall to the minimum over the edges and then jump to their label's label until nothing changes.
    """
    if not len(y):
        return np.zeros(0, np.int64)
    width = int(x.max() - x.min()) + 3
    key = (y - y.min()).astype(np.int64) * width + (x - x.min() + 1)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    edges = []
    for dy, dx in steps:
        at = np.searchsorted(ordered, ordered + dy * width + dx)
        at[at == len(ordered)] = 0
        hit = np.flatnonzero(ordered[at] == ordered + dy * width + dx)
        edges.append((hit, at[hit]))
    a, b = (np.concatenate(e) for e in zip(*edges))
    label = np.arange(len(key))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(key), np.int64)
    out[order] = order[label]
    return out


def components(mask: DataFrame, steps=FOUR, width: int = 64) -> DataFrame:
    """(img, y, x, label): each pixel with ``y * width + x`` of the first pixel of its component. An image is one task's work."""

    def one(pixels: pd.DataFrame) -> pd.DataFrame:
        y, x = pixels["y"].to_numpy(), pixels["x"].to_numpy()
        first = label_pixels(y, x, steps)
        return pixels.assign(label=y[first] * width + x[first])

    return mask.select("img", "y", "x").groupBy("img").applyInPandas(one, "img long, y long, x long, label long")


def blobs(labelled: DataFrame) -> DataFrame:
    """Bounding box and pixel count of every component."""
    return labelled.groupBy("img", "label").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x").alias("left_"), F.max("x").alias("right_"), F.count("*").alias("n"))


def not_garbage(found: DataFrame, width: int = 64, height: int = 64) -> DataFrame:
    """Blobs that may be writing: the box has 25 pixels to the image's limit, its aspect is within 20, a tenth is filled.

    The limit is the larger of a tenth of both sides, and the share of a blob if there are 40 or more.
    """
    total = found.groupBy("img").agg(F.count("*").alias("__blobs"))
    box = "((bottom - top + 1) * (right_ - left_ + 1))"
    most = f"greatest(case when __blobs >= 40 then ({width} div (__blobs div 40)) * ({height} div (__blobs div 40)) else 0 end, ({width} div 10) * ({height} div 10))"
    aspect = "((right_ - left_ + 1) <= 20 * (bottom - top + 1) and (bottom - top + 1) <= 20 * (right_ - left_ + 1))"
    return found.join(total, "img").where(f"{box} >= 25 and {box} <= {most} and {aspect} and n * 10 >= {box}").drop("__blobs")


def border_flooded(mask: DataFrame, all_pixels: DataFrame, width: int = 64) -> DataFrame:
    """Pixels that the background cannot reach from the image's edge: the mask with its holes filled."""
    ground = all_pixels.join(mask, ["img", "y", "x"], "left_anti")
    found = components(ground, EIGHT, width)
    ends = all_pixels.groupBy("img").agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    outer = found.join(ends, "img").where("y = 0 or x = 0 or y = __h or x = __w").select("img", "label").distinct()
    reached = found.join(outer, ["img", "label"], "left_semi")
    return all_pixels.join(reached, ["img", "y", "x"], "left_anti")
