"""Order-dependent merges inside one image or document: kernels over explicitly ordered rows.

Rows are dealt by image and sorted by the stated keys, so partitioning does not matter; a
task streams its images and holds one at a time. An image's segments, boxes or bands do not
grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.kernels.pages import slope_clusters
from pagelattice.kernels.text import merge_rects


def by_group(df: DataFrame, key: str, columns: tuple[str, ...], order: list, each: Callable, schema: str, kinds: tuple) -> DataFrame:
    """``each(key, rows)`` of every group, rows as tuples in order; it returns output rows. Many small groups share a batch."""

    def run(batches):
        held_key, held = None, []
        out: list[tuple] = []
        names = [p.split()[0] for p in schema.split(", ")]

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names)
            out.clear()
            return batch

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and k != held_key:
                    out.extend(each(held_key, held))
                    held = []
                held_key = k
                held.append(tuple(row))
            if len(out) > 5000:
                yield made()
        if held:
            out.extend(each(held_key, held))
        if out:
            yield made()

    return df.select(key, *columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


LONG = pa.int64()


def distinct_lines(lines: DataFrame, within_angle: float = math.pi / 36, within_rho: float = 5.0) -> DataFrame:
    """(img, id): by falling score, then id, the lines that no earlier one is like in angle and distance."""

    def each(img, rows):
        kept: list = []
        for i, angle, rho, _ in rows:
            if all(abs(angle - a) >= within_angle or abs(rho - r) >= within_rho for _, a, r in kept):
                kept.append((i, angle, rho))
        return [(img, i) for i, _, _ in kept]

    return by_group(lines, "img", ("id", "angle", "rho", "score"), [F.desc("score"), "id", "angle", "rho"], each, "img long, id long", (LONG, LONG))


def merged_boxes(rects: DataFrame, share: float = 0.6) -> DataFrame:
    """(img, x, y, w, h): boxes after two greedy rounds of uniting those that overlap by more than ``share`` of the smaller."""

    def each(img, rows):
        return [(img, *r) for r in merge_rects(rows, share)]

    return by_group(rects, "img", ("x", "y", "w", "h"), ["x", "y", "w", "h"], each, "img long, x long, y long, w long, h long", (LONG,) * 5)


def segment_blocks(segments: DataFrame, overlap: int = 20, apart: int = 50) -> DataFrame:
    """(img, id, block): segments from the top down; one joins the first block whose last segment it overlaps by ``overlap`` in x, at most ``apart`` below."""

    def each(img, rows):
        last: list = []
        out = []
        for i, x1, y1, x2, y2 in rows:
            mid, lo, hi = (y1 + y2) / 2, min(x1, x2), max(x1, x2)
            for k, (m, a, b) in enumerate(last):
                if min(hi, b) - max(lo, a) > overlap and mid - m <= apart:
                    last[k] = mid, lo, hi
                    out.append((img, i, k))
                    break
            else:
                last.append((mid, lo, hi))
                out.append((img, i, len(last) - 1))
        return out

    return by_group(segments, "img", ("id", "x1", "y1", "x2", "y2"), [F.col("y1") + F.col("y2"), "id", "x1", "x2", "y1"], each, "img long, id long, block long", (LONG,) * 3)


def steady_bands(bands: DataFrame, right: int = 20, left: int = 100) -> DataFrame:
    """(doc, band, min_x): bands after dropping, again and again, the first that jumps against the one before."""

    def each(doc, rows):
        kept: list = []
        for band, x in rows:  # dropping the first jump each time is one pass: a band is compared with the last that stays
            if not kept or -left <= x - kept[-1][1] <= right:
                kept.append((band, x))
        return [(doc, b, x) for b, x in kept]

    return by_group(bands, "doc", ("band", "min_x"), ["band"], each, "doc long, band long, min_x long", (LONG,) * 3)


def slopes(segments: DataFrame, width: float = 0.18) -> DataFrame:
    """(img, slope, votes): running-mean clusters of the segments' slopes in the order of their ids."""

    def each(img, rows):
        found = slope_clusters([(y2 - y1) / (x2 - x1) for _, x1, y1, x2, y2 in rows if x1 != x2], width)
        return [(img, float(k), int(n)) for k, n in found]

    return by_group(segments, "img", ("id", "x1", "y1", "x2", "y2"), ["id", "x1", "y1", "x2", "y2"], each, "img long, slope double, votes long", (LONG, pa.float64(), LONG))
