"""The page's outline in a photo: lines, opposite pairs, quadrangles, and the flattened page."""

from __future__ import annotations

import itertools
import math

import numpy as np

from pagelattice.kernels import filters as K
from pagelattice.kernels.pages import hough_segments

#: Parameter presets by mode: gradient threshold of a phase, and candidates kept.
PHASES = (180, 110, 40)
MASK_PHASES = (180,)


def polar(x1, y1, x2, y2) -> tuple[float, float]:
    """(rho, angle) of the line through two points; the angle is the normal's, in [0, 2 pi)."""
    cross = x1 * y2 - x2 * y1
    sign = -1 if cross < 0 else 1
    return abs(cross) / math.hypot(x2 - x1, y2 - y1), math.atan2(-(x2 - x1) * sign, (y2 - y1) * sign) % (2 * math.pi)


def longest_run(flags: np.ndarray) -> int:
    if not flags.any():
        return 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    return int((edges[1::2] - edges[::2]).max())


def line_score(edges: np.ndarray, segment, least: int = 10, gap: int = 60) -> float | None:
    """Support of a segment by edge pixels (a band of three across it); None if its longest run is short or its longest gap wide."""
    y, x = K.line_pixels(*segment)
    ok = (y >= 0) & (x >= 0) & (y < edges.shape[0]) & (x < edges.shape[1])
    if not ok.any():
        return None
    on = np.zeros(len(y), bool)
    for d in (-1, 0, 1):
        yy, xx = (y, x + d) if abs(segment[3] - segment[1]) > abs(segment[2] - segment[0]) else (y + d, x)
        inside = (yy >= 0) & (xx >= 0) & (yy < edges.shape[0]) & (xx < edges.shape[1])
        on[inside] |= edges[yy[inside], xx[inside]]
    if longest_run(on) < least or longest_run(~on) > gap:
        return None
    return float(on.sum())


def distinct_lines(segments, edges: np.ndarray) -> list[tuple]:
    """(score, rho, angle, segment) by falling score; of lines within five degrees and five pixels the best stays."""
    found = []
    for s in segments:
        score = line_score(edges, s)
        if score is not None:
            rho, angle = polar(*s)
            found.append((score + math.hypot(s[2] - s[0], s[3] - s[1]) / 5, rho, angle, tuple(s)))
    out: list = []
    for f in sorted(found, key=lambda f: (-f[0], f[3])):
        if all(abs(f[2] - o[2]) >= math.pi / 36 or abs(f[1] - o[1]) >= 5 for o in out):
            out.append(f)
    return out


def meet(p, q) -> tuple[float, float] | None:
    x1, y1, x2, y2 = p
    x3, y3, x4, y4 = q
    d = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    if d == 0:
        return None
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    return (a * (x3 - x4) - (x1 - x2) * b) / d, (a * (y3 - y4) - (y1 - y2) * b) / d


def order_corners(points) -> np.ndarray | None:
    """Top left, top right, bottom right, bottom left about the centre; None unless two are above it."""
    p = sorted(points, key=lambda c: c[1])
    cy = sum(c[1] for c in p) / 4
    up, down = sorted(c for c in p if c[1] < cy), sorted(c for c in p if c[1] >= cy)
    return np.array([up[0], up[1], down[1], down[0]], float) if len(up) == len(down) == 2 else None


def corner_angles(c: np.ndarray) -> list[float]:
    out, points = [], c.tolist()
    for k in range(4):
        (x, y), (x1, y1), (x2, y2) = points[k], points[k - 1], points[(k + 1) % 4]
        ax, ay, bx, by = x1 - x, y1 - y, x2 - x, y2 - y
        n = math.hypot(ax, ay) * math.hypot(bx, by)
        out.append(math.acos(max(-1.0, min(1.0, (ax * bx + ay * by) / n))) if n else 0.0)
    return out


def doubtful(c: np.ndarray) -> bool:
    """Too small, too uneven, or with exactly one acute corner."""
    side = [float(np.linalg.norm(c[k] - c[(k + 1) % 4])) for k in range(4)]
    if min(side[0], side[2]) < 50 or max(side[1], side[3]) / min(side[0], side[2]) > 2:
        return True
    g = corner_angles(c)
    wide, right = 8 * math.pi / 18, math.pi / 2
    uneven = (g[0] < wide and g[3] < wide and 2 * side[1] < side[3]) or (g[1] < right and g[2] < right and 2 * side[3] < side[1])
    uneven |= (g[0] < right and g[1] < right and 2 * side[2] < side[0]) or (g[2] < right and g[3] < right and 2 * side[0] < side[2])
    return uneven or sum(a < math.pi / 3 for a in g) == 1


def coverage(c: np.ndarray, mask: np.ndarray) -> tuple[float, float]:
    """(precision, recall) of a quadrangle against a mask; nothing if the mask has less than a tenth of the frame."""
    if mask.mean() < 0.1:
        return 0.0, 0.0
    h, w = mask.shape
    yy, xx = np.mgrid[0:h, 0:w]
    inside = np.ones((h, w), bool)
    for k in range(4):
        (x1, y1), (x2, y2) = c[k], c[(k + 1) % 4]
        inside &= (x2 - x1) * (yy - y1) - (y2 - y1) * (xx - x1) >= 0
    both = float((inside & mask).sum())
    return both / max(1, inside.sum()), both / mask.sum()


#: Fixed value: lines that are paired at most.
MOST_LINES = 1000


def quadrangles(gray: np.ndarray, threshold: float, most_pairs: int = 100, keep: int = 20) -> list[tuple[float, np.ndarray]]:
    """(score, corners) of the best page-like quadrangles of one phase, at the given image's size."""
    h, w = gray.shape
    gx, gy = K.sobel(K.blur(gray, 1.0, 2))
    size = np.minimum(np.abs(gx) + np.abs(gy), 510)
    edges = size > threshold
    thin = edges & (size >= K.blur(size, 1.0, 2))
    segments = hough_segments(thin, 2, 2, max(30, min(h, w) // 6), max(30, min(h, w) // 6), 20)
    lines = distinct_lines([tuple(s) for s in segments.tolist()], edges)[:MOST_LINES]
    level, upright = [], []
    for a, b in itertools.combinations(lines, 2):
        d = abs(a[2] - b[2])
        anti = 0.75 * math.pi <= d <= 1.25 * math.pi
        alike = d <= math.pi / 4 or d >= 1.75 * math.pi
        apart = a[1] + b[1] if anti else abs(a[1] - b[1])
        if not (anti or alike) or apart <= 0.1 * max(h, w):
            continue
        tilt = [abs(math.cos(x[2])) for x in (a, b)]
        if max(tilt) <= math.sqrt(0.5) + 1e-9:
            level.append((a, b))
        elif min(tilt) >= math.sqrt(0.5) - 1e-9:
            upright.append((a, b))
    found, known = [], {}
    for (a, b), (c, d) in itertools.product(level[:most_pairs], upright[:most_pairs]):
        points = [meet(p[3], q[3]) for p in (a, b) for q in (c, d)]
        if any(p is None or not (-10 <= p[0] <= w + 10 and -10 <= p[1] <= h + 10) for p in points):
            continue
        corners = order_corners(points)
        if corners is None or any(not math.pi / 3 <= g <= 2 * math.pi / 3 for g in corner_angles(corners)):
            continue
        sides = [tuple(np.rint([*corners[k], *corners[(k + 1) % 4]]).astype(int).tolist()) for k in range(4)]
        if sum(math.hypot(s[2] - s[0], s[3] - s[1]) for s in sides) <= (h + w) / 2:
            continue
        if doubtful(corners):
            continue
        for s in sides:  # many outlines share a side
            if s not in known:
                known[s] = line_score(edges, s)
        scores = [known[s] for s in sides]
        if any(s is None for s in scores):
            continue
        found.append((float(sum(scores)), corners))
    found.sort(key=lambda f: -f[0])
    top = found[0][0] if found else 0
    return [f for k, f in enumerate(found) if k < keep or f[0] > top / 3][:30]


def tilt(c: np.ndarray) -> float:
    """How far the sides of a quadrangle lean, in radians: nothing for a pair within five degrees of its axis."""
    x, y = np.abs(np.roll(c, -1, 0) - c).T
    level, upright = np.arctan2(y, x)[[0, 2]], np.arctan2(x, y)[[1, 3]]
    straight = math.pi / 36
    if (level < straight).all():
        return 0.0 if (upright < straight).all() else float(abs(upright[0] - upright[1]))
    apart = float(abs(level[0] - level[1]))
    return apart if (upright < straight).all() else float(abs(upright[0] - upright[1])) + apart + float(level[0])


def page_choice(found: list[tuple[float, np.ndarray]], most: int = 30) -> np.ndarray | None:
    """Of the ``most`` outlines with the best supported lines the one of the least place by length times one more than its lean.

    Lengths and leans count in whole pixels and radians; equals keep the order of their lines' support.
    """
    top = sorted(found, key=lambda f: -f[0])[:most]
    if not top:
        return None
    length = [int(np.linalg.norm(np.roll(c, -1, 0) - c, axis=1).sum()) for _, c in top]
    place = np.empty(len(top), int)
    place[np.argsort([-n for n in length], kind="stable")] = np.arange(len(top))
    return top[int(np.argmin([p * (1 + int(tilt(c))) for p, (_, c) in zip(place.tolist(), top)]))][1]


def page_border(image: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray | None:
    """Corners of the page at full size: from a salient mask if it gives some, else from the photo over three thresholds."""
    small, k = K.shrink_to(image.astype(float), 500)
    if mask is not None and mask.mean() >= 0.1:
        m, _ = K.shrink_to(mask.astype(float) * 255, 500)
        found = [f for t in MASK_PHASES for f in quadrangles(m, t, keep=3)]
        found = [f for f in found if min(coverage(f[1], m > 127)) > 0.85]
        if found:
            return max(found, key=lambda f: f[0])[1] / k
    gray = K.to_gray(np.clip(small, 0, 255).astype(np.uint8))
    chosen = page_choice([f for t in PHASES for f in quadrangles(gray, t)])
    return None if chosen is None else chosen / k


def flatten(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The page as a rectangle with the longer of its opposite sides; the image itself if the outline is degenerate."""
    side = [float(np.linalg.norm(corners[k] - corners[(k + 1) % 4])) for k in range(4)]
    w, h = round(max(side[0], side[2])), round(max(side[1], side[3]))
    if w < 2 or h < 2:
        return image
    try:
        out = K.rectify(image, corners, h, w)
    except np.linalg.LinAlgError:
        return image
    return np.clip(out + 0.5, 0, 255).astype(np.uint8)


def real_quadrangle(edges: np.ndarray, corners: np.ndarray) -> float | None:
    """Summed support of the four sides; None if one of them is no line."""
    scores = []
    for k in range(4):
        side = tuple(np.rint([*corners[k], *corners[(k + 1) % 4]]).astype(int).tolist())
        scores.append(line_score(edges, side))
        if scores[-1] is None:
            return None
    return float(sum(scores))


def text_outline(boxes: list[tuple[int, int, int, int]], frame: tuple[int, int]) -> np.ndarray | None:
    """A quadrangle around the largest block of text boxes: its edges run through the first and last boxes of each band of lines."""
    if len(boxes) < 2:
        return None
    b = np.array(sorted(boxes, key=lambda r: (r[1] + r[3] / 2, r[0])), float)
    mid = b[:, 1] + b[:, 3] / 2
    cuts = np.flatnonzero(np.diff(mid) > 2.5 * np.median(b[:, 3])) + 1
    block = max(np.split(np.arange(len(b)), cuts), key=len)
    own = b[block]
    band = np.floor((own[:, 1] - own[:, 1].min()) / max(20.0, float(np.median(own[:, 3])))).astype(int)
    rows = np.unique(band)
    left = np.array([own[band == k, 0].min() for k in rows])
    right = np.array([(own[band == k, 0] + own[band == k, 2]).max() for k in rows])
    ys = np.array([own[band == k, 1].mean() for k in rows])
    h, w = frame
    top, bottom = own[:, 1].min(), (own[:, 1] + own[:, 3]).max()

    def edge(xs, pick):
        k, c = np.polyfit(ys, xs, 1) if len(ys) > 1 else (0.0, float(pick(xs)))
        c += float(pick(xs - (k * ys + c)))
        return [float(np.clip(k * y + c, 0, w - 1)) for y in (top, bottom)]

    lt, lb = edge(left, np.min)
    rt, rb = edge(right, np.max)
    return np.array([[lt, top], [rt, top], [rb, min(bottom, h - 1)], [lb, min(bottom, h - 1)]])
