"""Text regions: extremal regions, stroke widths, component filters, line formation, and a template recogniser."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pagelattice.kernels import filters as K
from pagelattice.operators.components import EIGHT, RING, label_pixels


@dataclass(frozen=True)
class RegionParams:
    """Limits of an extremal region: level step, size, largest relative change and least difference of nested ones."""

    delta: int = 5
    least: int = 15
    most: int = 800
    variation: float = 0.25
    diversity: float = 0.2


def extremal_regions(gray: np.ndarray, params: RegionParams = RegionParams()) -> list[np.ndarray]:
    """Stable dark regions (flat pixel indices): components of ``gray <= t`` that hardly change over ``delta`` levels.

    Pixels are flooded by rising level; every component of every level is a node of a tree, and
    a node is kept where its relative growth is a minimum along its branch.
    """
    h, w = gray.shape
    flat = gray.ravel().astype(int)
    order = np.argsort(flat, kind="stable").tolist()
    parent = [-1] * (h * w)
    node_of: dict[int, int] = {}
    level, size, up, own, children = [], [], [], [], []

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def node(t, pixels, kids):
        level.append(t)
        size.append(len(pixels) + sum(size[k] for k in kids))
        up.append(-1)
        own.append(pixels)
        children.append(kids)
        for k in kids:
            up[k] = len(level) - 1
        return len(level) - 1

    at = 0
    while at < len(order):
        t = flat[order[at]]
        end = at
        while end < len(order) and flat[order[end]] == t:
            end += 1
        fresh = order[at:end]
        at = end
        below: dict[int, set[int]] = {}
        added: dict[int, list[int]] = {}
        for p in fresh:
            parent[p] = p
            added[p] = [p]
            below[p] = set()
        for p in fresh:
            y, x = divmod(p, w)
            for q in ((p - 1) if x else -1, (p + 1) if x < w - 1 else -1, p - w if y else -1, p + w if y < h - 1 else -1):
                if q < 0 or parent[q] < 0:
                    continue
                a, b = find(p), find(q)
                if a == b:
                    continue
                for r in (a, b):
                    if r not in added:
                        added[r], below[r] = [], {node_of[r]}
                if len(added[a]) < len(added[b]):
                    a, b = b, a
                parent[b] = a
                added[a] += added.pop(b)
                below[a] |= below.pop(b)
        for r, pixels in added.items():
            node_of[r] = node(t, pixels, sorted(below[r]))
    change = np.full(len(level), np.inf)
    for k in range(len(level)):
        a = k
        while up[a] >= 0 and level[up[a]] <= level[k] + params.delta:
            a = up[a]
        if up[a] >= 0 or level[a] > level[k]:
            change[k] = (size[a] - size[k]) / size[k]
    keep = []
    for k in range(len(level)):
        if not params.least <= size[k] <= params.most or change[k] > params.variation:
            continue
        if up[k] >= 0 and change[up[k]] < change[k]:
            continue
        if any(change[c] <= change[k] and size[c] >= params.least for c in children[k] if size[k] - size[c] < params.diversity * size[k]):
            continue
        keep.append(k)
    out = []
    for k in keep:
        pixels, stack = [], [k]
        while stack:
            n = stack.pop()
            pixels += own[n]
            stack += children[n]
        out.append(np.array(sorted(pixels)))
    return out


def extremal_mask(gray: np.ndarray, params: RegionParams = RegionParams()) -> np.ndarray:
    """The pixels of the stable dark and bright regions."""
    out = np.zeros(gray.size, bool)
    for g in (gray, 255 - gray):
        for r in extremal_regions(g, params):
            out[r] = True
    return out.reshape(gray.shape)


def grow_edges(edges: np.ndarray, gray: np.ndarray) -> np.ndarray:
    """Every edge pixel also sets its neighbour down the gradient's direction."""
    gx, gy = K.sobel(gray)
    code = np.floor(np.mod(np.degrees(np.arctan2(gy, gx)) + 22.5, 360) / 45).astype(int)
    steps = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
    out = edges.copy()
    y, x = np.nonzero(edges)
    for k, (dy, dx) in enumerate(steps):
        own = code[y, x] == k
        ny, nx = y[own] + dy, x[own] + dx
        ok = (ny >= 0) & (nx >= 0) & (ny < out.shape[0]) & (nx < out.shape[1])
        out[ny[ok], nx[ok]] = True
    return out


def stroke_width(mask: np.ndarray) -> np.ndarray:
    """Twice the ridge distance of a stroke at all its pixels: ridge values flow down to smaller neighbours until nothing changes."""
    d = np.rint(K.distance(mask))
    width = d.copy()
    p = np.pad(d, 1)
    h, w = d.shape
    lower = [(p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] > d) & mask for dy, dx in RING]
    while True:
        q = np.pad(width, 1)
        now = width
        for (dy, dx), ok in zip(RING, lower):
            now = np.where(ok, np.maximum(now, q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]), now)
        if (now == width).all():
            return 2 * width * mask
        width = now


@dataclass
class Component:
    y: np.ndarray
    x: np.ndarray

    @property
    def area(self) -> int:
        return len(self.y)

    @property
    def box(self) -> tuple[int, int, int, int]:
        return int(self.x.min()), int(self.y.min()), int(np.ptp(self.x)) + 1, int(np.ptp(self.y)) + 1

    @property
    def eccentricity(self) -> float:
        cov = np.cov(np.stack([self.x, self.y])) if self.area > 1 else np.zeros((2, 2))
        lo, hi = np.linalg.eigvalsh(cov)
        return float(np.sqrt(max(0.0, 1 - lo / hi))) if hi > 0 else 0.0

    @property
    def solidity(self) -> float:
        """Area over the area of the pixels' convex hull."""
        return min(1.0, self.area / max(hull_area(self.x, self.y), 1e-9))


def convex_hull(points: np.ndarray) -> np.ndarray:
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Of the pixels as unit squares."""
    corners = np.concatenate([np.stack([x + i, y + j], 1) for i in (0, 1) for j in (0, 1)])
    p = convex_hull(corners).astype(float)
    nxt = np.roll(p, -1, 0)
    return abs(float((p[:, 0] * nxt[:, 1] - p[:, 1] * nxt[:, 0]).sum())) / 2


def components_of(mask: np.ndarray) -> list[Component]:
    y, x = np.nonzero(mask)
    if not len(y):
        return []
    label = label_pixels(y, x, EIGHT)
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    return sorted((Component(y[p], x[p]) for p in np.split(order, cuts)), key=lambda c: (-c.area, c.box[1], c.box[0]))


@dataclass(frozen=True)
class TextParams:
    least: int = 15
    most: int = 800
    ecc: tuple[float, float] = (0.1, 0.995)
    solidity: float = 0.4
    deviation: float = 0.5
    low: int = 20
    high: int = 100
    regions: RegionParams = RegionParams()


def text_components(image: np.ndarray, params: TextParams = TextParams()) -> tuple[np.ndarray, list[Component]]:
    """(mask, components) of what looks like writing: edges inside extremal regions, filtered by shape and even stroke width."""
    gray = K.to_gray(image)
    stable = extremal_mask(gray, params.regions)
    edges = K.canny(gray, params.low, params.high) & stable
    kept = stable & ~grow_edges(edges, gray)
    shaped = [c for c in components_of(kept) if params.least <= c.area <= params.most and params.ecc[0] <= c.eccentricity <= params.ecc[1] and c.solidity >= params.solidity]
    first = np.zeros(gray.shape, bool)
    for c in shaped:
        first[c.y, c.x] = True
    widths = stroke_width(first)
    out, mask = [], np.zeros(gray.shape, bool)
    for c in shaped:
        v = widths[c.y, c.x]
        v = v[v > 0]
        if len(v) and v.std() <= params.deviation * v.mean():
            out.append(c)
            mask[c.y, c.x] = True
    return mask, out


def merge_rects(rects: list[tuple[int, int, int, int]], share: float = 0.6) -> list[tuple[int, int, int, int]]:
    """Greedy union of boxes whose overlap is more than ``share`` of the smaller; twice, in order of place."""

    def ratio(a, b):
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        return max(w, 0) * max(h, 0) / min(a[2] * a[3], b[2] * b[3])

    for _ in range(2):
        out: list = []
        for r in sorted(rects):
            for k, o in enumerate(out):
                if ratio(r, o) > share:
                    x, y = min(r[0], o[0]), min(r[1], o[1])
                    out[k] = (x, y, max(r[0] + r[2], o[0] + o[2]) - x, max(r[1] + r[3], o[1] + o[3]) - y)
                    break
            else:
                out.append(r)
        rects = out
    return rects


def text_lines(boxes: list[tuple[int, int, int, int]], frame: tuple[int, int], pad: int = 5) -> list[tuple[int, int, int, int]]:
    """Boxes around text lines: the pair whose line passes near most boxes, those boxes removed, and again; four boxes make a line."""
    h, w = frame
    left = sorted(boxes)
    found = []
    while len(left) > 3:
        b = np.array(left, float)
        c = np.stack([b[:, 0] + b[:, 2] / 2, b[:, 1] + b[:, 3] / 2], 1)
        best: np.ndarray | None = None
        for i in range(len(b)):
            for j in range(i + 1, len(b)):
                dx, dy = c[j] - c[i]
                if abs(dy) >= 15 or abs(dx) >= 50 + max(b[i, 2], b[j, 2]) or dx == 0 or abs(dy / dx) >= 0.3:
                    continue
                far = np.abs((c[:, 0] - c[i, 0]) * dy - (c[:, 1] - c[i, 1]) * dx) / np.hypot(dx, dy)
                near = np.flatnonzero(far <= max(b[i, 3], b[j, 3]) / 2)
                if best is None or len(near) > len(best):
                    best = near
        if best is None or len(best) <= 3:
            break
        own = b[best]
        x1, y1 = own[:, 0].min() - pad, own[:, 1].min() - pad
        x2, y2 = (own[:, 0] + own[:, 2]).max() + pad, (own[:, 1] + own[:, 3]).max() + pad
        x1, y1, x2, y2 = max(0, x1), max(0, y1), min(w, x2), min(h, y2)
        found.append((int(x1), int(y1), int(x2 - x1), int(y2 - y1)))
        used = set(best.tolist())
        left = [r for k, r in enumerate(left) if k not in used]
    return merge_rects(found)


def text_regions(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of text lines at full size, top down."""
    small, levels = K.pyramid(image, 800, sharpen=True)
    _, parts = text_components(np.clip(small, 0, 255).astype(np.uint8))
    k = 1 << levels
    lines = text_lines([c.box for c in parts], small.shape[:2])
    return sorted(((x * k, y * k, w * k, h * k) for x, y, w, h in lines), key=lambda r: (r[1], r[0]))


def page_kind(gray: np.ndarray) -> int:
    """1: a page of level text lines; 0: a straight page; -1: a photo."""
    from pagelattice.kernels.pages import edge_mask, hough_segments, slope_clusters

    segments = hough_segments(edge_mask(gray), 1, 1, 100, 70, 20).tolist()
    if not segments:
        return -1
    slopes = [(y2 - y1) / (x2 - x1) for x1, y1, x2, y2 in segments if x1 != x2]
    upright = sum(x1 == x2 or abs((y2 - y1) / (x2 - x1)) > 5 for x1, y1, x2, y2 in segments)
    level = max((n for k, n in slope_clusters(slopes) if abs(k) < 0.5), default=0)
    if level >= 5 and level > 0.6 * len(segments):
        return 1
    return 0 if upright + level > 0.8 * len(segments) else -1


#: A font of five by seven cells for tests and for the built-in recogniser: one number a row.
FONT = {
    "A": (14, 17, 17, 31, 17, 17, 17), "B": (30, 17, 17, 30, 17, 17, 30), "C": (14, 17, 16, 16, 16, 17, 14), "D": (30, 17, 17, 17, 17, 17, 30),
    "E": (31, 16, 16, 30, 16, 16, 31), "F": (31, 16, 16, 30, 16, 16, 16), "H": (17, 17, 17, 31, 17, 17, 17), "I": (14, 4, 4, 4, 4, 4, 14),
    "L": (16, 16, 16, 16, 16, 16, 31), "N": (17, 25, 21, 19, 17, 17, 17), "O": (14, 17, 17, 17, 17, 17, 14), "P": (30, 17, 17, 30, 16, 16, 16),
    "R": (30, 17, 17, 30, 20, 18, 17), "S": (15, 16, 16, 14, 1, 1, 30), "T": (31, 4, 4, 4, 4, 4, 4), "U": (17, 17, 17, 17, 17, 17, 14),
    "G": (14, 17, 16, 23, 17, 17, 15), "J": (7, 2, 2, 2, 2, 18, 12), "K": (17, 18, 20, 24, 20, 18, 17), "M": (17, 27, 21, 21, 17, 17, 17),
    "Q": (14, 17, 17, 17, 21, 18, 13), "V": (17, 17, 17, 17, 17, 10, 4), "W": (17, 17, 17, 21, 21, 21, 10), "X": (17, 17, 10, 4, 10, 17, 17),
    "Y": (17, 17, 17, 10, 4, 4, 4), "Z": (31, 1, 2, 4, 8, 16, 31),
    "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (31, 2, 4, 2, 1, 17, 14),
    "4": (2, 6, 10, 18, 31, 2, 2), "5": (31, 16, 30, 1, 1, 17, 14), "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8),
    "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12),
}


def glyph(letter: str, scale: int = 1) -> np.ndarray:
    rows = FONT[letter]
    cells = np.array([[r >> (4 - k) & 1 for k in range(5)] for r in rows], bool)
    return np.kron(cells, np.ones((scale, scale), bool))


def render(lines: list[str], scale: int = 3, margin: int = 12) -> np.ndarray:
    """Black text on white in the built-in font."""
    height = margin * 2 + len(lines) * 10 * scale
    width = margin * 2 + max((len(t) for t in lines), default=0) * 6 * scale
    out = np.full((height, width), 255, np.uint8)
    for r, line in enumerate(lines):
        for k, ch in enumerate(line):
            if ch in FONT:
                y, x = margin + r * 10 * scale, margin + k * 6 * scale
                out[y : y + 7 * scale, x : x + 5 * scale][glyph(ch, scale)] = 0
    return out


def recognize(gray: np.ndarray) -> str:
    """Text in the built-in font by best-matching template; other recognisers plug in at the stage."""
    ink = gray < 128
    rows = np.flatnonzero(ink.any(1))
    if not len(rows):
        return ""
    lines = np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1)
    templates = {k: glyph(k).astype(float) for k in FONT}
    out = []
    for line in lines:
        band = ink[line[0] : line[-1] + 1]
        scale = max(1, round(len(band) / 7))
        columns = np.flatnonzero(band.any(0))
        if len(columns) == 0 or len(line) < 3:
            continue
        letters, last = "", None
        cell = 6 * scale
        for part in np.split(columns, np.flatnonzero(np.diff(columns) > 1) + 1):
            centre = (part[0] + part[-1]) / 2
            if last is not None:
                letters += " " * max(0, round((centre - last) / cell) - 1)
            last = centre
            piece = band[:, part[0] : part[-1] + 1]
            best, name = -1.0, "?"
            for ch, t in templates.items():
                filled = np.flatnonzero(t.any(0))
                u = t[:, filled[0] : filled[-1] + 1]
                if abs(u.shape[1] * scale - piece.shape[1]) > scale:
                    continue
                v = K.resize(piece.astype(float), 7, u.shape[1]) > 0.5
                score = float((v == u).mean())
                if score > best:
                    best, name = score, ch
            letters += name
        out.append(letters)
    return "\n".join(out)


def color_regions(bgr: np.ndarray, params: RegionParams = RegionParams(), levels: int = 40) -> list[np.ndarray]:
    """Stable colour regions (flat pixel indices): neighbours merge by rising chi-squared distance of their colours;
    a region is kept at a level over which it hardly grows. Levels rise with the square root of the distance."""
    from pagelattice.kernels.regions import DisjointSets, grid_edges

    h, w = bgr.shape[:2]
    one, two, _ = grid_edges(bgr)
    a, b = bgr.reshape(-1, bgr.shape[-1])[one].astype(float), bgr.reshape(-1, bgr.shape[-1])[two].astype(float)
    chi = ((a - b) ** 2 / np.maximum(a + b, 1)).sum(1)
    order = np.lexsort((two, one, chi))
    cuts = chi.max(initial=0) * np.linspace(0, 1, levels + 1)[:-1] ** 2
    sets = DisjointSets(h * w)
    at, kept, before = 0, {}, {}
    for t in cuts:
        while at < len(order) and chi[order[at]] <= t:
            p, q = sets.find(one[order[at]]), sets.find(two[order[at]])
            if p != q:
                sets.join(p, q)
            at += 1
        root = np.array([sets.find(i) for i in range(h * w)])
        names, first, size = np.unique(root, return_index=True, return_counts=True)
        now = {int(f): (int(n), int(s)) for f, n, s in zip(first, names, size)}
        for f, (n, s) in now.items():
            if f in before and params.least <= s <= params.most and (s - before[f]) <= params.variation * before[f] and f not in kept:
                kept[f] = np.flatnonzero(root == n)
        before = {f: s for f, (_, s) in now.items()}
    return [kept[f] for f in sorted(kept)]


def keypoints(regions: list[np.ndarray], width: int) -> list[tuple[float, float, float]]:
    """(x, y, diameter) of the ellipse with each region's moments."""
    out = []
    for r in regions:
        y, x = r // width, r % width
        cov = np.cov(np.stack([x, y])) if len(r) > 1 else np.zeros((2, 2))
        out.append((float(x.mean()), float(y.mean()), 4 * float(np.sqrt(np.sqrt(max(np.linalg.det(cov), 0))))))
    return out
