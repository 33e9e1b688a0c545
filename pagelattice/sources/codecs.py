"""Image files: PNG (zlib and numpy), PGM and PPM, and the VLIB raster."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def write_png(a: np.ndarray) -> bytes:
    """8-bit gray or BGR levels as PNG."""
    a = np.ascontiguousarray(a, np.uint8)
    rows = a if a.ndim == 2 else a[..., ::-1]
    h, w = a.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows.reshape(h, -1)], 1).tobytes()

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Gray or BGR levels of an 8-bit PNG (gray, colour, palette, with or without alpha; not interlaced)."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    w, h, depth, color, _, _, interlace = head
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG without interlace")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            for c in range(n):
                row[c::n] = np.cumsum(row[c::n], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            a = above.astype(int)
            for x in range(w * n):
                left = int(row[x - n]) if x >= n else 0
                corner = int(a[x - n]) if x >= n else 0
                if kind == 3:
                    guess = (left + a[x]) // 2
                else:
                    p = left + a[x] - corner
                    d = abs(p - left), abs(p - a[x]), abs(p - corner)
                    guess = left if d[0] <= d[1] and d[0] <= d[2] else a[x] if d[1] <= d[2] else corner
                row[x] = (int(row[x]) + int(guess)) & 255
        out[y] = above = row
    if color == 3:
        return palette[out][..., ::-1]
    px = out.reshape(h, w, n)
    return px[..., 0] if color in (0, 4) else px[..., 2::-1]


def _header(data: bytes, count: int) -> tuple[list[bytes], int]:
    """``count`` tokens of a text header (comments begin with #) and where the body begins."""
    out, at = [], 0
    while len(out) < count:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("header ends early")
        out.append(data[at:end])
        at = end
    return out, at + 1


def read_pnm(data: bytes) -> np.ndarray:
    (kind, w, h, top), at = _header(data, 4)
    if kind not in (b"P5", b"P6") or int(top) != 255:
        raise ValueError("only binary PGM and PPM of 255 levels")
    a = np.frombuffer(data, np.uint8, int(w) * int(h) * (1 if kind == b"P5" else 3), at)
    return a.reshape(int(h), int(w)) if kind == b"P5" else a.reshape(int(h), int(w), 3)[..., ::-1]


def write_pnm(a: np.ndarray) -> bytes:
    h, w = a.shape[:2]
    body = a if a.ndim == 2 else a[..., ::-1]
    return f"P{5 if a.ndim == 2 else 6}\n{w} {h}\n255\n".encode() + np.ascontiguousarray(body, np.uint8).tobytes()


def read_vlib(data: bytes, dtype: str = "u1") -> np.ndarray:
    """A VLIB raster: the word VLIB, width and height, then raw little-endian values by row."""
    (kind, w, h), at = _header(data, 3)
    if kind != b"VLIB":
        raise ValueError("not a VLIB raster")
    return np.frombuffer(data, np.dtype(dtype).newbyteorder("<"), int(w) * int(h), at).reshape(int(h), int(w))


def write_vlib(a: np.ndarray) -> bytes:
    return f"VLIB\n{a.shape[1]} {a.shape[0]}\n".encode() + np.ascontiguousarray(a, a.dtype.newbyteorder("<")).tobytes()


def decode(data: bytes) -> np.ndarray:
    """By signature."""
    if data[:8] == SIGNATURE:
        return read_png(data)
    if data[:2] in (b"P5", b"P6"):
        return read_pnm(data)
    if data[:4] == b"VLIB":
        return read_vlib(data)
    raise ValueError("unknown image format")
