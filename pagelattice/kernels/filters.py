"""Linear filters, pyramids, morphology, edges, distances and warps of 2-D arrays."""

from __future__ import annotations

import math

import numpy as np

EDGE = {"reflect": "reflect", "replicate": "edge"}


def convolve(image: np.ndarray, row: np.ndarray, column: np.ndarray, border: str = "reflect") -> np.ndarray:
    """Separable correlation with odd kernels; ``reflect`` leaves the edge pixel single, ``replicate`` repeats it."""
    a = image.astype(np.float64)
    for axis, kernel in ((1, np.asarray(row, float)), (0, np.asarray(column, float))):
        r = len(kernel) // 2
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        mode = EDGE[border] if a.shape[axis] > r else "edge"
        p = np.pad(a, pad, mode=mode)
        n = a.shape[axis]
        a = sum(w * np.take(p, range(k, k + n), axis) for k, w in enumerate(kernel) if w) if kernel.any() else np.zeros_like(a)
    return a


def gaussian(sigma: float, radius: int | None = None) -> np.ndarray:
    radius = max(1, math.ceil(sigma * 4)) if radius is None else radius
    x = np.arange(-radius, radius + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum()


def blur(image: np.ndarray, sigma: float, radius: int | None = None, border: str = "reflect") -> np.ndarray:
    k = gaussian(sigma, radius)
    return convolve(image, k, k, border)


def sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return convolve(image, [-1, 0, 1], [1, 2, 1]), convolve(image, [1, 2, 1], [-1, 0, 1])


def to_gray(bgr: np.ndarray) -> np.ndarray:
    if bgr.ndim == 2:
        return bgr
    return np.clip(bgr @ np.array([0.114, 0.587, 0.299]) + 0.5, 0, 255).astype(np.uint8)


def to_lab(bgr: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of sRGB levels under D65."""
    u = bgr[..., ::-1].astype(np.float64) / 255
    lin = np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4)
    m = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = lin @ m.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    return np.stack([light, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def stretch(a: np.ndarray, top: float = 255.0) -> np.ndarray:
    lo, hi = float(a.min()), float(a.max())
    return np.zeros(a.shape) if hi <= lo else (a - lo) * (top / (hi - lo))


def box_stats(gray: np.ndarray, wy: int, wx: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every full wy x wx box, from prefix sums: one value for each box position."""
    a = np.pad(gray.astype(np.float64), ((1, 0), (1, 0)))
    s, q = a.cumsum(0).cumsum(1), (a * a).cumsum(0).cumsum(1)
    box = lambda t: t[wy:, wx:] - t[:-wy, wx:] - t[wy:, :-wx] + t[:-wy, :-wx]
    n = wy * wx
    mean = box(s) / n
    return mean, np.sqrt(np.maximum(box(q) / n - mean * mean, 0))


FIVE = np.array([1, 4, 6, 4, 1]) / 16


def pyramid_down(image: np.ndarray) -> np.ndarray:
    return convolve(image, FIVE, FIVE)[::2, ::2]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    return sample(image, *np.meshgrid(y, x, indexing="ij"))


def sample(image: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float | None = None) -> np.ndarray:
    """Bilinear values at real coordinates; beyond the edge ``outside``, or the edge itself."""
    h, w = image.shape[:2]
    beyond = (y < 0) | (x < 0) | (y > h - 1) | (x > w - 1)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    a = image.astype(np.float64)
    out = a[y0, x0] * (1 - fy) * (1 - fx) + a[y0, x1] * (1 - fy) * fx + a[y1, x0] * fy * (1 - fx) + a[y1, x1] * fy * fx
    if outside is not None:
        out[beyond] = outside
    return out


def shrink_to(image: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """The image with its longer side at most ``most``, and the factor."""
    k = most / max(image.shape[:2])
    if k >= 1:
        return image, 1.0
    return resize(image, max(1, round(image.shape[0] * k)), max(1, round(image.shape[1] * k))), k


def pyramid(image: np.ndarray, most: int = 800, sharpen: bool = False) -> tuple[np.ndarray, int]:
    """Halved until no side exceeds ``most``; the image itself if it is small already. Returns it and the number of halvings."""
    out, levels = image.astype(np.float64), 0
    while max(out.shape[:2]) > most:
        out, levels = pyramid_down(out), levels + 1
    if sharpen and levels:
        out = np.clip(1.5 * out - 0.5 * blur(out, 3), 0, 255)
    return out, levels


def rotate(image: np.ndarray, degrees: float, fill: float = 0) -> np.ndarray:
    """About the centre, counter-clockwise, same frame."""
    h, w = image.shape[:2]
    t = math.radians(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    dx, dy = xx - cx, yy - cy
    return sample(image, cy + math.sin(t) * dx + math.cos(t) * dy, cx + math.cos(t) * dx - math.sin(t) * dy, fill)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes four points (x, y) to four others."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1).reshape(3, 3)


def rectify(image: np.ndarray, corners: np.ndarray, height: int, width: int) -> np.ndarray:
    """The quadrangle (top left, top right, bottom right, bottom left) as a rectangle."""
    to = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    back = homography(to, corners)
    yy, xx = np.mgrid[0:height, 0:width]
    p = np.stack([xx, yy, np.ones_like(xx)], -1) @ back.T
    return sample(image, p[..., 1] / p[..., 2], p[..., 0] / p[..., 2])


def morph(mask: np.ndarray, element: np.ndarray, grow: bool) -> np.ndarray:
    """Dilation (``grow``) or erosion by a centred element; outside counts as empty when growing, as full when shrinking."""
    ry, rx = element.shape[0] // 2, element.shape[1] // 2
    p = np.pad(mask.astype(bool), ((ry, ry), (rx, rx)), constant_values=not grow)
    h, w = mask.shape
    parts = [p[dy : dy + h, dx : dx + w] for dy, dx in zip(*np.nonzero(element))]
    return np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)


def disk(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return y * y + x * x <= radius * radius + radius * 0.8


def opening(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    return morph(morph(mask, element, False), element, True)


def closing(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    return morph(morph(mask, element, True), element, False)


def canny(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """Sobel gradients, thinning across the edge, and hysteresis."""
    from pagelattice.operators.components import EIGHT, label_pixels

    gx, gy = sobel(gray)
    size = np.abs(gx) + np.abs(gy)
    angle = np.mod(np.arctan2(gy, gx), np.pi)
    p = np.pad(size, 1)
    h, w = size.shape
    shift = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    sector = np.floor(angle / (np.pi / 4) + 0.5).astype(int) % 4
    steps = ((0, 1), (1, 1), (1, 0), (1, -1))
    thin = np.zeros((h, w), bool)
    for k, (dy, dx) in enumerate(steps):
        thin |= (sector == k) & (size > shift(-dy, -dx)) & (size >= shift(dy, dx))
    weak = thin & (size > low)
    y, x = np.nonzero(weak)
    out = np.zeros((h, w), bool)
    if len(y):
        label = label_pixels(y, x, EIGHT)
        strong = np.unique(label[size[y, x] > high])
        keep = np.isin(label, strong)
        out[y[keep], x[keep]] = True
    return out


def distance(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance (0.955, 1.3693) of every set pixel to the nearest empty one."""
    far = np.where(mask, np.inf, 0.0)
    a, b = 0.955, 1.3693
    h, w = far.shape
    d = np.pad(far, 1, constant_values=np.inf)
    across = np.arange(w + 2) * a
    for rows, step in ((range(1, h + 1), 1), (range(h, 0, -1), -1)):
        for y in rows:
            up = d[y - step]
            row = np.minimum(d[y, 1:-1], np.minimum(up[1:-1] + a, np.minimum(up[:-2], up[2:]) + b))
            line = np.concatenate([[np.inf], row, [np.inf]])
            ahead = np.minimum.accumulate(line - across) + across
            back = np.minimum.accumulate((line + across)[::-1])[::-1] - across
            d[y] = np.minimum(np.minimum(line, ahead), back)
            d[y, 0] = d[y, -1] = np.inf
    out = d[1:-1, 1:-1]
    return np.where(np.isfinite(out), out, float(h + w))


def line_pixels(x1: int, y1: int, x2: int, y2: int) -> tuple[np.ndarray, np.ndarray]:
    """The pixels (y, x) of a segment, one for each step along its longer side."""
    n = max(abs(x2 - x1), abs(y2 - y1)) + 1
    return np.rint(np.linspace(y1, y2, n)).astype(int), np.rint(np.linspace(x1, x2, n)).astype(int)


def draw_line(canvas: np.ndarray, segment, value) -> None:
    y, x = line_pixels(*segment)
    ok = (y >= 0) & (x >= 0) & (y < canvas.shape[0]) & (x < canvas.shape[1])
    canvas[y[ok], x[ok]] = value


def draw_rect(canvas: np.ndarray, x: int, y: int, w: int, h: int, value) -> None:
    for s in ((x, y, x + w - 1, y), (x, y + h - 1, x + w - 1, y + h - 1), (x, y, x, y + h - 1), (x + w - 1, y, x + w - 1, y + h - 1)):
        draw_line(canvas, s, value)


def convolution_matrix(kernel: np.ndarray, height: int, width: int) -> np.ndarray:
    """The matrix that maps a flattened height x width image to its valid correlation with the kernel."""
    kh, kw = kernel.shape
    oh, ow = height - kh + 1, width - kw + 1
    out = np.zeros((oh * ow, height * width))
    for y in range(oh):
        for x in range(ow):
            for dy in range(kh):
                out[y * ow + x, (y + dy) * width + x : (y + dy) * width + x + kw] = kernel[dy]
    return out


def equalize(gray: np.ndarray) -> np.ndarray:
    """Levels spread by their cumulative share."""
    share = np.cumsum(np.bincount(gray.ravel(), minlength=256)) / gray.size
    return np.rint(255 * share)[gray].astype(np.uint8)
