"""Segmentation, saliency by region contrast, and the cut of the salient region."""

from __future__ import annotations

import numpy as np

from pagelattice.kernels import filters as K
from pagelattice.operators.components import EIGHT, FOUR, label_pixels


class DisjointSets:
    """Union by rank with path halving over numpy arrays."""

    def __init__(self, n: int):
        self.parent, self.rank, self.size = np.arange(n), np.zeros(n, np.int32), np.ones(n, np.int64)

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return int(a)

    def join(self, a: int, b: int) -> int:
        if self.rank[a] < self.rank[b]:
            a, b = b, a
        self.parent[b] = a
        self.size[a] += self.size[b]
        self.rank[a] += self.rank[a] == self.rank[b]
        return a


def grid_edges(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, weight) of the right, down, down right and up right neighbours; weight is the colour distance."""
    h, w = image.shape[:2]
    a3 = image.reshape(h, w, -1).astype(np.float64)
    index = np.arange(h * w).reshape(h, w)
    parts = []
    for one, two in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:]), (np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[1:, :-1], np.s_[:-1, 1:])):
        parts.append((index[one].ravel(), index[two].ravel(), np.sqrt(((a3[one] - a3[two]) ** 2).sum(-1)).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts))


def graph_segments(image: np.ndarray, k: float = 200, least: int = 500, sigma: float = 0.95) -> np.ndarray:
    """Labels 0.. in raster order of a graph-based segmentation: edges by rising weight join regions whose inner variation allows it.

    Ties are taken in the order of the pixels.
    """
    a = K.blur(K.to_lab(image) if image.ndim == 3 else image, sigma, border="replicate")
    one, two, weight = grid_edges(a)
    order = np.lexsort((two, one, weight))
    h, w = a.shape[:2]
    sets = DisjointSets(h * w)
    bound = np.full(h * w, float(k))
    for e in order.tolist():
        p, q = sets.find(one[e]), sets.find(two[e])
        if p != q and weight[e] <= bound[p] and weight[e] <= bound[q]:
            r = sets.join(p, q)
            bound[r] = weight[e] + k / sets.size[r]
    for e in order.tolist():
        p, q = sets.find(one[e]), sets.find(two[e])
        if p != q and (sets.size[p] < least or sets.size[q] < least):
            sets.join(p, q)
    roots = np.array([sets.find(i) for i in range(h * w)])
    _, first, inverse = np.unique(roots, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse].reshape(h, w)


def quantize(bgr: np.ndarray, bins: int = 12, drop: float = 0.05, least: int = 10, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(index of each pixel's colour, mean colour of each index): rare colours join the nearest frequent one."""
    q = (bgr.astype(np.int64) * (bins * 10000 - 1)) // 2550000
    key = (q[..., 0] * bins + q[..., 1]) * bins + q[..., 2]
    keys, where, count = np.unique(key, return_inverse=True, return_counts=True)
    order = np.lexsort((-keys, -count))
    tail = np.cumsum(count[order][::-1])[::-1]
    kept = int(min(max((tail >= drop * count.sum()).sum(), least), most, len(keys)))
    top = order[:kept]
    digits = np.stack([keys // (bins * bins), keys // bins % bins, keys % bins], 1)
    to = np.empty(len(keys), int)
    to[top] = np.arange(kept)
    for k in order[kept:]:
        to[k] = int(((digits[top] - digits[k]) ** 2).sum(1).argmin())
    index = to[where.reshape(key.shape)]
    mean = np.stack([np.bincount(index.ravel(), bgr[..., c].ravel().astype(float), kept) for c in range(3)], 1)
    return index, mean / np.maximum(np.bincount(index.ravel(), minlength=kept), 1)[:, None]


def region_contrast(bgr: np.ndarray, labels: np.ndarray, sigma: float = 0.4) -> np.ndarray:
    """Saliency in [0, 1]: a region stands out by its colour distance to the others, weighted by their size and nearness."""
    index, colors = quantize(bgr)
    n, count = int(labels.max()) + 1, len(colors)
    if count <= 1 or n <= 1:
        return np.zeros(labels.shape)
    lab = K.to_lab(colors[None])[0]
    apart = np.sqrt(((lab[:, None] - lab[None]) ** 2).sum(-1))
    share = np.bincount(labels.ravel() * count + index.ravel(), minlength=n * count).reshape(n, count).astype(float)
    size = share.sum(1)
    share /= size[:, None]
    h, w = labels.shape
    yy, xx = np.mgrid[0:h, 0:w]
    centre = np.stack([np.bincount(labels.ravel(), v.ravel(), n) / size for v in (yy / h, xx / w)], 1)
    near = np.exp(-((centre[:, None] - centre[None]) ** 2).sum(-1) / sigma)
    contrast = ((share @ apart @ share.T) * near * size[None]).sum(1)
    off = np.stack([np.bincount(labels.ravel(), np.abs(v - 0.5).ravel(), n) / size for v in (yy / h, xx / w)], 1)
    score = contrast * np.exp(-9 * (off**2).sum(1))
    score = np.where(border_regions(labels) > 0.4, 0, score)
    by_color = np.bincount(index.ravel(), score[labels].ravel(), count) / np.maximum(np.bincount(index.ravel(), minlength=count), 1)
    take = max(2, round(count * 0.1))
    nearest = np.argsort(apart, axis=1, kind="stable")[:, :take]
    weight = np.take_along_axis(apart, nearest, 1)
    weight = weight.sum(1, keepdims=True) - weight + 1e-9
    smooth = (by_color[nearest] * weight).sum(1) / weight.sum(1)
    mean = np.bincount(labels.ravel(), smooth[index].ravel(), n) / size
    return K.stretch(mean[labels], 1.0)


def border_regions(labels: np.ndarray, band: int = 2) -> np.ndarray:
    """For each region the pixels in the frame's border bands over its spread: high where a region runs along the border."""
    h, w = labels.shape
    n = int(labels.max()) + 1
    size = np.maximum(np.bincount(labels.ravel(), minlength=n), 1)
    yy, xx = np.mgrid[0:h, 0:w]
    spread = np.zeros(n)
    for v, side in ((yy, h), (xx, w)):
        mean = np.bincount(labels.ravel(), v.ravel(), n) / size
        spread += np.bincount(labels.ravel(), np.abs(v - mean[labels]).ravel(), n) / size / side
    near = np.zeros(n)
    for part in (labels[:band], labels[-band:], labels[:, :band], labels[:, -band:]):
        near += np.bincount(part.ravel(), minlength=n)
    return near / (2 * band * (h + w)) / np.maximum(spread, 1e-9) * 2


def regions_of(mask: np.ndarray, steps=FOUR) -> tuple[np.ndarray, np.ndarray]:
    """(label image with -1 outside, sizes) of the connected regions of a mask."""
    out = np.full(mask.shape, -1)
    y, x = np.nonzero(mask)
    if not len(y):
        return out, np.zeros(0, int)
    _, label, size = np.unique(label_pixels(y, x, steps), return_inverse=True, return_counts=True)
    out[y, x] = label
    return out, size


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Everything the background cannot reach from the frame."""
    label, size = regions_of(~mask, EIGHT)
    edge = np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]])
    reach = np.zeros(len(size) + 1, bool)
    reach[edge[edge >= 0]] = True
    return ~(reach[label] & (label >= 0))


def cut_region(score: np.ndarray, labels: np.ndarray, low: float = 0.1, high: float = 0.9, seed: int = 7) -> np.ndarray:
    """The salient region as a mask: the largest strong component if it is large enough, holes filled.

    Else the regions off the border, else what is joined to the centre and a fixed ring of seeds.
    """
    for t in (high * score.max(), (low + high) / 2 * score.max(), max(low, 1e-9)):
        label, size = regions_of(score >= t, EIGHT)
        if len(size) and size.max() > 0.1 * score.size:
            return fill_holes(label == int(size.argmax()))
    edge = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    inner = ~np.isin(labels, edge)
    if inner.mean() > 0.05:
        return fill_holes(inner)
    label, size = regions_of(score >= low, EIGHT)
    h, w = score.shape
    turn = np.linspace(0, 2 * np.pi, 10, endpoint=False)
    seeds = [(h // 2, w // 2)] + [(int(h / 2 + h / 6 * np.sin(t)), int(w / 2 + w / 6 * np.cos(t))) for t in turn]
    wanted = {int(label[y, x]) for y, x in seeds} - {-1}
    return np.isin(label, list(wanted)) if wanted else np.zeros(score.shape, bool)


def salient_mask(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, segment labels) at full size: shrink, segment, score, cut, enlarge."""
    small, _ = K.pyramid(bgr, 200)
    small = np.clip(small, 0, 255)
    sigma = 1.2 if float(np.sqrt(((small - small.mean((0, 1))) ** 2).sum(-1).mean())) > 100 else 0.95
    labels = graph_segments(small, 200, max(20, small.shape[0] * small.shape[1] // 200), sigma)
    mask = cut_region(region_contrast(np.rint(small), labels), labels)
    h, w = bgr.shape[:2]
    y, x = np.arange(h) * mask.shape[0] // h, np.arange(w) * mask.shape[1] // w
    return mask[np.ix_(y, x)], labels[np.ix_(y, x)]


def rank_weights(pairs: list[tuple[np.ndarray, np.ndarray]], epochs: int = 50, rate: float = 0.01) -> np.ndarray:
    """Weights in [0, 10] that score the first vector of each pair over the second: pairwise descent on a hinge."""
    w = np.ones(len(pairs[0][0]))
    for _ in range(epochs):
        for up, down in pairs:
            if w @ (up - down) < 1:
                w = np.clip(w + rate * (up - down), 0, 10)
    return w


def gaussian_mixture(points: np.ndarray, parts: int = 5, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, covariances): split along the widest component, then hard assignment."""
    label = np.zeros(len(points), int)
    for k in range(1, parts):
        spread = [np.linalg.eigh(np.cov(points[label == j], rowvar=False) if (label == j).sum() > points.shape[1] else np.eye(points.shape[1]) * 1e-9) for j in range(k)]
        j = int(np.argmax([v[-1] for v, _ in spread]))
        own = np.flatnonzero(label == j)
        side = (points[own] - points[own].mean(0)) @ spread[j][1][:, -1]
        label[own[side > 0]] = k
    for _ in range(rounds + 1):
        weight = np.bincount(label, minlength=parts) / len(points)
        mean = np.stack([points[label == j].mean(0) if (label == j).any() else points.mean(0) for j in range(parts)])
        cov = np.stack([np.cov(points[label == j], rowvar=False) + np.eye(points.shape[1]) * 1e-3 if (label == j).sum() > 1 else np.eye(points.shape[1]) for j in range(parts)])
        off = points[:, None] - mean[None]
        cost = np.einsum("nki,kij,nkj->nk", off, np.linalg.inv(cov), off) + np.log(np.linalg.det(cov)) - 2 * np.log(np.maximum(weight, 1e-12))
        now = cost.argmin(1)
        if (now == label).all():
            break
        label = now
    return weight, mean, cov


def min_cut(capacity: dict[tuple[int, int], float], nodes: int, source: int, sink: int) -> tuple[float, np.ndarray]:
    """(flow, source side) by shortest augmenting paths with level graphs."""
    graph: list[list[list]] = [[] for _ in range(nodes)]
    for (a, b), c in capacity.items():
        graph[a].append([b, float(c), len(graph[b])])
        graph[b].append([a, 0.0, len(graph[a]) - 1])
    flow = 0.0
    while True:
        level = np.full(nodes, -1)
        level[source] = 0
        queue = [source]
        for a in queue:
            for b, c, _ in graph[a]:
                if c > 1e-12 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[sink] < 0:
            return flow, level >= 0
        at = [0] * nodes
        while True:
            path, a = [], source
            while a != sink:
                while at[a] < len(graph[a]):
                    e = graph[a][at[a]]
                    if e[1] > 1e-12 and level[e[0]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] == len(graph[a]):
                    if not path:
                        break
                    a = path.pop()[0]
                    at[a] += 1
                    continue
                path.append((a, graph[a][at[a]]))
                a = graph[a][at[a]][0]
            if a != sink:
                break
            least = min(e[1] for _, e in path)
            flow += least
            for _, e in path:
                e[1] -= least
                graph[e[0]][e[2]][1] += least


def grid_cut(links: np.ndarray, gain: np.ndarray, seeds: np.ndarray, sweeps: int = 8) -> np.ndarray:
    """The source side of a minimum cut of a pixel grid, as ``min_cut`` gives it: the pixels that the source still reaches.

    ``links`` has the capacities, the same both ways, in the order of ``grid_edges``; ``gain`` is what a pixel takes from the source
    less what it gives to the sink; ``seeds`` is 255 for pixels of the source, 0 for those of the sink. Flow is pushed back from the
    sink by all pixels at once, along heights that are measured anew every few sweeps; pixels that reach the source are its side.
    """
    h, w = gain.shape
    wide, least, far = w + 2, 1e-12, np.int32(1 << 28)
    size, pad = (h + 2) * wide, w + 3
    inner, core = np.s_[1 : h + 1, 1 : w + 1], slice(pad, size - pad)
    # a rim of one pixel without links: a neighbour is a shift of the flat image
    room, begin = np.zeros((8, h + 2, wide)), 0
    for k, (dy, dx) in enumerate(((0, 1), (1, 0), (1, 1), (-1, 1))):
        one, two = (slice(1 + max(0, -dy), h + 1 - max(0, dy)), slice(1, w + 1 - dx)), (slice(1 + max(0, dy), h + 1 - max(0, -dy)), slice(1 + dx, w + 1))
        shape = room[k][one].shape
        room[k][one] = room[k + 4][two] = links[begin : begin + shape[0] * shape[1]].reshape(shape)
        begin += shape[0] * shape[1]
    room = room.reshape(8, size)
    shifts = [sign * o for sign in (1, -1) for o in (1, wide, wide + 1, 1 - wide)]
    over = lambda a, o: a[pad + o : size - pad + o]
    kind = np.full((h + 2, wide), 128, np.uint8)
    kind[inner] = seeds
    kind = kind.ravel()
    source, sink = kind == 255, kind == 0
    excess = np.zeros((h + 2, wide))
    excess[inner] = -gain
    excess = excess.ravel()
    for r, o in zip(room, shifts):  # a seed's links belong to its neighbours
        excess[core] += r[core] * over(sink, o) - r[core] * over(source, o)
        r[core][(source | sink)[core] | over(source | sink, o)] = 0
    excess[source | sink] = 0
    height = np.zeros(size, np.int32)
    e, up = excess[core], height[core]
    ways = [(room[k][core], over(room[(k + 4) % 8], o), over(excess, o), over(height, o)) for k, o in enumerate(shifts)]
    while True:
        height[:] = np.where(excess < -least, 0, far)
        steps = [np.where(r > least, np.int32(1), far) for r, *_ in ways]
        while True:
            before = up.copy()
            for step, (*_, theirs) in zip(steps, ways):
                np.minimum(up, theirs + step, out=up)
            if (before == up).all():
                break
        if not ((e > least) & (up < far)).any():
            return ((height < far) & ~sink | source).reshape(h + 2, wide)[inner]
        for _ in range(sweeps):
            for r, back, other, theirs in ways:
                f = np.maximum(np.minimum(e, r), 0) * (up == theirs + 1)
                e -= f
                other += f
                r -= f
                back += f
            lowest = np.minimum.reduce([np.where(r > least, theirs, far - 1) for r, _, _, theirs in ways]) + 1
            np.copyto(up, lowest, where=(e > least) & (lowest > up))


def grab_cut(bgr: np.ndarray, trimap: np.ndarray, rounds: int = 3, smooth: float = 50.0) -> np.ndarray:
    """Foreground mask from a trimap (0 background, 128 unknown, 255 foreground): colour mixtures and minimum cuts in turn."""
    h, w = trimap.shape
    points = bgr.reshape(-1, 3).astype(float)
    mask = trimap.ravel() > 0
    weight = grid_edges(bgr)[2]
    beta = 1 / max(2 * float((weight**2).mean()), 1e-9)
    link = smooth * np.exp(-beta * weight**2)
    for _ in range(rounds):
        cost = []
        for side in (mask, ~mask):
            if side.sum() < 10:
                return mask.reshape(h, w)
            wt, mean, cov = gaussian_mixture(points[side], 3, 5)
            off = points[:, None] - mean[None]
            d = np.einsum("nki,kij,nkj->nk", off, np.linalg.inv(cov), off)
            cost.append(-np.log((wt * np.exp(-d / 2) / np.sqrt(np.linalg.det(cov))).sum(1) + 1e-300))
        now = grid_cut(link, (cost[1] - cost[0]).reshape(h, w), trimap).ravel()
        if (now == mask).all():
            break
        mask = now
    return mask.reshape(h, w)


def color_contrast(bgr: np.ndarray) -> np.ndarray:
    """Saliency of each colour alone: its distance to all colours of the image by their share."""
    index, colors = quantize(bgr)
    if len(colors) <= 1:
        return np.zeros(index.shape)
    lab = K.to_lab(colors[None])[0]
    apart = np.sqrt(((lab[:, None] - lab[None]) ** 2).sum(-1))
    share = np.bincount(index.ravel(), minlength=len(colors)) / index.size
    return K.stretch((apart @ share)[index], 1.0)


def flood_from(mask: np.ndarray, seeds: list[tuple[int, int]], steps=EIGHT) -> np.ndarray:
    """The parts of a mask that contain a seed."""
    label, _ = regions_of(mask, steps)
    h, w = mask.shape
    wanted = {int(label[y, x]) for y, x in seeds if 0 <= y < h and 0 <= x < w} - {-1}
    return np.isin(label, list(wanted)) if wanted else np.zeros(mask.shape, bool)


#: Six of the eight neighbours, as the fill that looks back along a row and to the next one sees them.
SIX = ((0, 1), (1, 0), (1, 1), (0, -1), (-1, 0), (1, -1))


def reached_regions(mask: np.ndarray, offsets=SIX) -> np.ndarray:
    """Labels (-1 outside) of a fill from each unlabelled pixel in raster order over the given, not necessarily symmetric, offsets."""
    h, w = mask.shape
    out = np.full((h, w), -1)
    label = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x] >= 0:
            continue
        out[y, x] = label
        queue = [(int(y), int(x))]
        for cy, cx in queue:
            for dy, dx in offsets:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and out[ny, nx] < 0:
                    out[ny, nx] = label
                    queue.append((ny, nx))
        label += 1
    return out
