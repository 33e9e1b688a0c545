"""Row types of images and what is found in them, and their numpy forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

#: Spark's own image struct: BGR order; mode 0 is one 8-bit channel, 16 is three.
IMAGE = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("nChannels", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
IMAGE_ROWS = "image_id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
PIECES = "image_id long, piece int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
BOXES = "image_id long, piece int, x int, y int, w int, h int"
MODES = {0: 1, 16: 3, 24: 4}


def to_array(image: dict) -> np.ndarray:
    """height x width (x channels) levels; asserts that the struct is consistent."""
    h, w, n = image["height"], image["width"], image["nChannels"]
    if MODES.get(image["mode"]) != n:
        raise ValueError(f"mode {image['mode']} does not have {n} channels")
    a = np.frombuffer(image["data"], np.uint8)
    if a.size != h * w * n:
        raise ValueError(f"{a.size} bytes are not {h} x {w} x {n}")
    a = a.reshape(h, w) if n == 1 else a.reshape(h, w, n)[..., :3]
    return a


def to_struct(a: np.ndarray, origin: str = "") -> dict:
    a = np.ascontiguousarray(np.clip(a, 0, 255).astype(np.uint8))
    n = 1 if a.ndim == 2 else a.shape[2]
    return {"origin": origin, "height": a.shape[0], "width": a.shape[1], "nChannels": n, "mode": {1: 0, 3: 16}[n], "data": a.tobytes()}
