"""Page clean-up: binarisation, denoising, garbage removal, skew, noise level, augmentation."""

from __future__ import annotations

import math

import numpy as np

from pagelattice.kernels import filters as K
from pagelattice.operators.components import FOUR, label_pixels


def window_divisor(level: float) -> float:
    return 3.5 if level < 1 else level if level < 1.5 else (level - 1.6) / 1.4 * 14 + 1


def local_threshold(gray: np.ndarray, wy: int, wx: int, rule: str = "wolf", k: float = 0.5, span: float = 128.0) -> np.ndarray:
    """Threshold surface of niblack, sauvola or wolf; where the box leaves the image, the nearest inner threshold."""
    h, w = gray.shape
    wy, wx = min(wy | 1, h - 1 + h % 2), min(wx | 1, w - 1 + w % 2)
    mean, sd = K.box_stats(gray, wy, wx)
    if rule == "niblack":
        th = mean + k * sd
    elif rule == "sauvola":
        th = mean * (1 + k * (sd / span - 1))
    elif rule == "wolf":
        top = sd.max()
        th = mean + k * (sd / top - 1) * (mean - gray.min()) if top > 0 else mean
    else:
        raise ValueError(f"unknown threshold rule: {rule}")
    y = np.clip(np.arange(h) - wy // 2, 0, th.shape[0] - 1)
    x = np.clip(np.arange(w) - wx // 2, 0, th.shape[1] - 1)
    return th[np.ix_(y, x)]


def binarize(gray: np.ndarray, rule: str = "wolf", k: float = 0.5, level: float | None = None) -> np.ndarray:
    """Black ink on white; the window is the image's sides over a divisor that follows the noise level."""
    level = noise_level(gray) if level is None else level
    d = max(window_divisor(level), 1.0)
    wy, wx = max(3, int(gray.shape[0] / d)), max(3, int(gray.shape[1] / d))
    return np.where(gray >= local_threshold(gray, wy, wx, rule, k), 255, 0).astype(np.uint8)


def majority_tiles(binary: np.ndarray, side: int = 3) -> np.ndarray:
    """Complete tiles take their majority, black on a tie; the rest stays."""
    out = binary.copy()
    h, w = binary.shape[0] // side * side, binary.shape[1] // side * side
    t = (binary[:h, :w] > 127).reshape(h // side, side, w // side, side).sum((1, 3))
    vote = np.where(t * 2 > side * side, 255, 0).astype(binary.dtype)
    out[:h, :w] = np.repeat(np.repeat(vote, side, 0), side, 1)
    return out


def salt_pepper_denoise(gray: np.ndarray, t: int = 127) -> np.ndarray:
    b = np.where(gray > t, 255, 0).astype(np.uint8)
    return np.where(K.blur(majority_tiles(b), 0.8, 1) > t, 255, 0).astype(np.uint8)


def gaussian_denoise(gray: np.ndarray) -> np.ndarray:
    return np.clip(K.blur(gray, 0.8, 1) + 0.5, 0, 255).astype(np.uint8)


def remove_garbage(gray: np.ndarray) -> np.ndarray:
    """White out ink components too small, too large, too thin or too hollow to be writing."""
    ink = gray < 128
    y, x = np.nonzero(ink)
    if not len(y):
        return gray.copy()
    _, label, n = np.unique(label_pixels(y, x, FOUR), return_inverse=True, return_counts=True)
    count = len(n)
    ends = [np.full(count, v) for v in (1 << 30, -1, 1 << 30, -1)]
    np.minimum.at(ends[0], label, y)
    np.maximum.at(ends[1], label, y)
    np.minimum.at(ends[2], label, x)
    np.maximum.at(ends[3], label, x)
    h, w = ends[1] - ends[0] + 1, ends[3] - ends[2] + 1
    hh, ww = gray.shape
    most = (ww // 10) * (hh // 10)
    if count >= 40:
        most = max(most, (ww // (count // 40)) * (hh // (count // 40)))
    keep = (h * w >= 25) & (h * w <= most) & (w <= 20 * h) & (h <= 20 * w) & (n * 10 >= h * w)
    out = np.full_like(gray, 255)
    k = keep[label]
    out[y[k], x[k]] = gray[y[k], x[k]]
    return out


def hough_votes(mask: np.ndarray, theta_step: float = 1.0, rho_step: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(votes by theta and rho, thetas in degrees, smallest rho)."""
    theta = np.arange(0, 180, theta_step)
    far = math.hypot(*mask.shape)
    return _votes(*np.nonzero(mask), theta, rho_step, far), theta, -far


def _votes(y: np.ndarray, x: np.ndarray, theta: np.ndarray, rho_step: float, far: float) -> np.ndarray:
    t, bins = np.deg2rad(theta), int(2 * far / rho_step) + 2
    votes = np.zeros((len(theta), bins), np.int64)
    for k in range(len(theta)):
        rho = ((x * math.cos(t[k]) + y * math.sin(t[k]) + far) / rho_step + 0.5).astype(int)
        votes[k] = np.bincount(rho, minlength=bins)
    return votes


def hough_segments(mask: np.ndarray, rho_step: float = 1, theta_step: float = 1, votes: int = 100, least: int = 70, gap: int = 20, most: int = 5000) -> np.ndarray:
    """Segments (x1, y1, x2, y2) on the strongest lines, without chance: each line takes its pixels, and their votes, away
    from the later ones."""
    left = mask.astype(bool).copy()
    table, theta, low = hough_votes(left, theta_step, rho_step)
    out = []
    y, x = np.nonzero(left)
    strong = np.flatnonzero(table >= votes)
    for flat in strong[np.argsort(-table.reshape(-1)[strong], kind="stable")]:
        k, r = divmod(int(flat), table.shape[1])
        if len(out) >= most:
            break
        if table[k, r] < votes:
            continue
        t = math.radians(theta[k])
        near = np.abs(x * math.cos(t) + y * math.sin(t) - (low + r * rho_step)) <= max(1.0, rho_step / 2 + 0.5)
        if near.sum() < least:
            continue
        px, py = x[near], y[near]
        along = px * -math.sin(t) + py * math.cos(t)
        order = np.argsort(along, kind="stable")
        cuts = np.flatnonzero(np.diff(along[order]) > gap) + 1
        for part in np.split(order, cuts):
            a, b = part[0], part[-1]
            if math.hypot(px[b] - px[a], py[b] - py[a]) >= least:
                out.append((px[a], py[a], px[b], py[b]))
                left[py[part], px[part]] = False
                table -= _votes(py[part], px[part], theta, rho_step, -low)
        y, x = np.nonzero(left) if not left[py, px].all() else (y, x)
    return np.array(out, int).reshape(-1, 4)


def slope_clusters(slopes, width: float = 0.18) -> list[tuple[float, int]]:
    """Clusters of slopes in input order: a slope joins every cluster whose running mean is within ``width``, or begins one."""
    out: list[list] = []
    for k in slopes:
        hit = False
        for c in out:
            if abs(c[0] - k) < width:
                c[0] = (c[0] * c[1] + k) / (c[1] + 1)
                c[1] += 1
                hit = True
        if not hit:
            out.append([k, 1])
    return [(m, n) for m, n in out]


def edge_mask(gray: np.ndarray, t: float = 128) -> np.ndarray:
    gx, gy = K.sobel(gray)
    return np.minimum(np.abs(gx), 255) * 0.5 + np.minimum(np.abs(gy), 255) * 0.5 > t


def ink_profile_skew(gray: np.ndarray, limit: float = 15.0, step: float = 0.25) -> float:
    """The rotation at which the rows' ink varies most, in degrees; positive where the lines rise to the right."""
    small, _ = K.shrink_to(gray, 600)
    y, x = np.nonzero(small < (float(small.min()) + float(small.max())) / 2)
    if len(y) < 50:
        return 0.0
    best, angle = -1.0, 0.0
    for a in np.arange(-limit, limit + step / 2, step):
        t = math.radians(a)
        rows = np.rint(y * math.cos(t) + x * math.sin(t)).astype(int)
        n = np.bincount(rows - rows.min()).astype(float)
        score = float(((n[1:] - n[:-1]) ** 2).sum())
        if score > best + 1e-9:
            best, angle = score, float(a)
    return angle


def skew(gray: np.ndarray) -> float:
    """Degrees of the dominant slope of long edges, or of the ink profile where no edge is long enough."""
    segments = hough_segments(edge_mask(gray), 1, 1, 100, 70, 20)
    slopes = [(y2 - y1) / (x2 - x1) for x1, y1, x2, y2 in segments.tolist() if x1 != x2 and abs(y2 - y1) < abs(x2 - x1)]
    if len(slopes) >= 5:
        mean, _ = max(slope_clusters(slopes), key=lambda c: c[1])
        return -math.degrees(math.atan(mean))
    return ink_profile_skew(gray)


def deskew(gray: np.ndarray, fill: float = 255) -> np.ndarray:
    a = skew(gray) if gray.size else 0.0
    return gray.copy() if abs(a) < 0.1 else np.clip(K.rotate(gray, -a, fill) + 0.5, 0, 255).astype(np.uint8)


def gamma_quantile(p: float, shape: float, scale: float) -> float:
    """Inverse of the gamma distribution function by bisection on the incomplete gamma series."""

    def cdf(x):
        x /= scale
        if x <= 0:
            return 0.0
        term = total = 1 / shape
        for n in range(1, 10_000):
            term *= x / (shape + n)
            total += term
            if term < total * 1e-14:
                break
        return min(1.0, total * math.exp(-x + shape * math.log(x) - math.lgamma(shape)))

    lo, hi = 0.0, scale * (shape + 40 * math.sqrt(shape) + 40)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def noise_level(image: np.ndarray, side: int = 7, confidence: float = 1 - 1e-6, rounds: int = 25) -> float:
    """Deviation of additive noise: the smallest principal component of patches too weak in texture to be structure."""
    channels = [image] if image.ndim == 2 else [image[..., c] for c in range(image.shape[2])]
    found = []
    for a in channels:
        a, _ = K.shrink_to(a.astype(np.float64), 256)
        if min(a.shape) < side + 2:
            found.append(0.0)
            continue
        patches = np.lib.stride_tricks.sliding_window_view(a, (side, side)).reshape(-1, side * side)
        gx = np.lib.stride_tricks.sliding_window_view(K.convolve(a, [-0.5, 0, 0.5], [1], "replicate"), (side, side))
        gy = np.lib.stride_tricks.sliding_window_view(K.convolve(a, [1], [-0.5, 0, 0.5], "replicate"), (side, side))
        texture = ((gx**2).sum((2, 3)) + (gy**2).sum((2, 3))).reshape(-1)
        unit = gamma_quantile(confidence, side * side / 2, 2.0 / (side * side)) * side * side  # of gradient energy at variance 1
        smallest = lambda p: float(max(0.0, np.linalg.eigvalsh(np.cov(p, rowvar=False))[0]))
        var = smallest(patches)
        for _ in range(rounds):
            weak = patches[texture < var * unit]
            if len(weak) <= side * side:
                break
            now = smallest(weak)
            if abs(now - var) < 1e-6:
                break
            var = now
        found.append(math.sqrt(var))
    return float(np.mean(found))


def add_gaussian(image: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.clip(image + rng.normal(0, sigma, image.shape) + 0.5, 0, 255).astype(np.uint8)


def add_salt_pepper(image: np.ndarray, share: float, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed).random(image.shape[:2])
    out = image.copy()
    out[r < share / 2], out[r > 1 - share / 2] = 0, 255
    return out


def blend_background(image: np.ndarray, ground: np.ndarray, alpha: float = 0.7) -> np.ndarray:
    return np.clip(alpha * image + (1 - alpha) * K.resize(ground, *image.shape[:2]) + 0.5, 0, 255).astype(np.uint8)


def random_polygons(height: int, width: int, count: int, seed: int) -> np.ndarray:
    """A background of convex patches of random level."""
    rng = np.random.default_rng(seed)
    out = np.full((height, width), 255, np.uint8)
    yy, xx = np.mgrid[0:height, 0:width]
    for _ in range(count):
        cy, cx, r = rng.integers(height), rng.integers(width), rng.integers(3, max(4, min(height, width) // 2))
        turn = np.sort(rng.random(5)) * 2 * np.pi
        px, py = cx + r * np.cos(turn), cy + r * np.sin(turn)
        inside = np.ones((height, width), bool)
        for k in range(5):
            j = (k + 1) % 5
            inside &= (px[j] - px[k]) * (yy - py[k]) - (py[j] - py[k]) * (xx - px[k]) >= 0
        out[inside] = rng.integers(0, 256)
    return out
