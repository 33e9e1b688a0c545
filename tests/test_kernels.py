"""Kernels against brute force, and properties that hold whatever the image."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from pagelattice.kernels import border, filters, pages, regions, text
from pagelattice.operators.components import EIGHT, FOUR, label_pixels
from pagelattice.sources import codecs

rasters = hnp.arrays(np.uint8, st.tuples(st.integers(3, 16), st.integers(3, 16)))
masks = hnp.arrays(bool, st.tuples(st.integers(1, 12), st.integers(1, 12)))


def flood(mask, eight):
    out, label = np.full(mask.shape, -1), 0
    for start in zip(*np.nonzero(mask)):
        if out[start] >= 0:
            continue
        stack = [start]
        out[start] = label
        while stack:
            y, x = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy or dx) and (eight or not dy or not dx):
                        q = y + dy, x + dx
                        if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and out[q] < 0:
                            out[q] = label
                            stack.append(q)
        label += 1
    return out


@settings(max_examples=60, deadline=None)
@given(masks, st.booleans())
def test_labels_match_flood(mask, eight):
    y, x = np.nonzero(mask)
    first = label_pixels(y, x, EIGHT if eight else FOUR)
    want = flood(mask, eight)[y, x]
    _, mine = np.unique(first, return_inverse=True)
    assert len(set(zip(mine.tolist(), want.tolist()))) == len(set(mine.tolist())) == len(set(want.tolist()))


@settings(max_examples=40, deadline=None)
@given(rasters)
def test_box_stats_match_brute_force(a):
    mean, sd = filters.box_stats(a, 3, 3)
    for y in range(mean.shape[0]):
        for x in range(mean.shape[1]):
            part = a[y : y + 3, x : x + 3].astype(float)
            assert abs(mean[y, x] - part.mean()) < 1e-9 and abs(sd[y, x] - part.std()) < 1e-6


@settings(max_examples=40, deadline=None)
@given(rasters)
def test_codecs_round_trip(a):
    assert (codecs.read_png(codecs.write_png(a)) == a).all()
    assert (codecs.read_pnm(codecs.write_pnm(a)) == a).all()
    assert (codecs.read_vlib(codecs.write_vlib(a)) == a).all()
    color = np.stack([a, 255 - a, a // 2], -1)
    assert (codecs.read_png(codecs.write_png(color)) == color).all()
    assert (codecs.decode(codecs.write_pnm(color)) == color).all()


@settings(max_examples=30, deadline=None)
@given(rasters)
def test_binarise_and_denoise_are_two_valued(a):
    for rule in ("wolf", "sauvola", "niblack"):
        assert set(np.unique(pages.binarize(a, rule, level=1.0))) <= {0, 255}
    assert set(np.unique(pages.salt_pepper_denoise(a))) <= {0, 255}


@settings(max_examples=30, deadline=None)
@given(masks)
def test_morphology_is_dual_and_ordered(m):
    e = np.ones((3, 3), bool)
    assert (filters.morph(m, e, False) <= m).all() and (filters.morph(m, e, True) >= m).all()
    assert (filters.opening(m, e) <= m).all() and (filters.closing(m, e) >= m).all()


def test_distance_close_to_euclid():
    rng = np.random.default_rng(0)
    m = rng.random((20, 24)) < 0.9
    zy, zx = np.nonzero(~m)
    y, x = np.mgrid[0:20, 0:24]
    exact = np.sqrt(((y[..., None] - zy) ** 2 + (x[..., None] - zx) ** 2).min(-1))
    got = filters.distance(m)
    assert (got[~m] == 0).all() and np.abs(got - exact).max() <= 0.1 * exact.max() + 0.05


def test_warp_and_rotation_return():
    a = text.render(["TEST", "LINE"])
    there = filters.rotate(a, 0)
    assert np.abs(there - a).max() < 1e-9
    h, w = a.shape
    corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    assert np.abs(filters.rectify(a, corners, h, w) - a).max() < 1e-6


@pytest.mark.parametrize("degrees", [-6, -2, 3, 8])
def test_deskew_finds_the_angle(degrees):
    page = text.render(["THE HOUSE IN THE SUN", "POTATO SALAD AND RICE", "LIST OF THE STONES", "HELP US UNTIL NOON"] * 2)
    turned = filters.rotate(np.pad(page, 60, constant_values=255), degrees, 255)
    assert abs(pages.ink_profile_skew(turned) - degrees) <= 0.75
    assert abs(pages.ink_profile_skew(pages.deskew(turned.astype(np.uint8)))) <= 0.75


@pytest.mark.parametrize("degrees", [-30, -20, 25])
def test_deskew_straightens_beyond_fifteen_degrees(degrees):
    page = text.render(["THE HOUSE IN THE SUN", "POTATO SALAD AND RICE", "LIST OF THE STONES", "HELP US UNTIL NOON"] * 2)
    turned = filters.rotate(np.pad(page, 150, constant_values=255), degrees, 255).astype(np.uint8)
    straight = np.abs(filters.rotate(turned, -degrees, 255) - pages.deskew(turned))
    assert straight.mean() <= 0.5 * np.abs(filters.rotate(turned, -degrees, 255) - turned).mean()


def test_noise_level_rises_with_noise():
    yy, xx = np.mgrid[0:96, 0:96]
    smooth = (128 + 40 * np.sin(yy / 20) + 30 * np.cos(xx / 25)).astype(np.uint8)
    found = [pages.noise_level(pages.add_gaussian(smooth, s, 1)) for s in (2, 6, 14)]
    assert found[0] < found[1] < found[2] and abs(found[2] - 14) < 4


def test_gamma_quantile():
    assert abs(pages.gamma_quantile(0.5, 1, 1) - math.log(2)) < 1e-9
    assert abs(pages.gamma_quantile(0.95, 0.5, 2) - 3.841458820694124) < 1e-6


def test_segments_and_saliency_of_two_tones():
    a = np.full((60, 60, 3), 230, np.uint8)
    a[15:45, 18:42] = (20, 30, 200)
    labels = regions.graph_segments(a, 200, 30)
    assert labels[0, 0] == 0 and len(np.unique(labels)) >= 2 and labels[30, 30] != labels[2, 2]
    mask, _ = regions.salient_mask(a)
    inside = np.zeros((60, 60), bool)
    inside[15:45, 18:42] = True
    assert (mask & inside).sum() > 0.8 * inside.sum() and (mask & ~inside).sum() < 0.2 * (~inside).sum()
    assert (regions.region_contrast(np.full((9, 9, 3), 7, np.uint8), np.zeros((9, 9), int)) == 0).all()


def test_fill_holes():
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    m[4, 4] = False
    assert regions.fill_holes(m).sum() == 25 and not regions.fill_holes(np.zeros((5, 5), bool)).any()


def test_extremal_regions_of_blobs():
    a = np.full((40, 40), 220, np.uint8)
    a[5:12, 5:11] = 20
    a[20:30, 22:31] = 60
    found = sorted(len(r) for r in text.extremal_regions(a))
    assert found == [42, 90]
    assert text.extremal_mask(255 - a).sum() == text.extremal_mask(a).sum()


def test_stroke_width_is_even_on_bars():
    m = np.zeros((30, 40), bool)
    m[5:25, 10:15] = True
    w = text.stroke_width(m)[8:22, 10:15]
    assert w.min() == w.max() > 0


def test_hull_and_solidity():
    y, x = np.mgrid[0:5, 0:7]
    assert text.hull_area(x.ravel(), y.ravel()) == 35
    assert text.Component(y.ravel(), x.ravel()).solidity == 1.0


def test_text_lines_group_boxes():
    boxes = [(20 + 30 * k, 40 + k % 2, 18, 20) for k in range(6)] + [(25 + 30 * k, 120, 18, 20) for k in range(5)] + [(200, 300, 9, 9)]
    lines = text.text_lines(boxes, (400, 400))
    assert len(lines) == 2 and all(w > 120 for _, _, w, _ in lines)


def test_recogniser_reads_its_font():
    assert text.recognize(text.render(["HELLO SUN", "PART 12"])) == "HELLO SUN\nPART 12"
    lines = ["ABCDEFGHIJKLM", "NOPQRSTUVWXYZ", "0123456789"]
    assert text.recognize(text.render(lines)) == "\n".join(lines)


def test_page_choice_prefers_length_among_the_best_lines():
    def quad(x, y, w, h, lean=0):
        return np.array([[x, y], [x + w, y + lean], [x + w, y + h], [x, y + h]], float)

    assert border.page_choice([]) is None
    small, large = (90.0, quad(10, 10, 100, 100)), (80.0, quad(0, 0, 200, 150))
    assert border.page_choice([small, large]) is large[1]
    # beyond the best supported the length does not count
    assert border.page_choice([small, *[(85.0, quad(0, 0, 90, 90))] * 29, large]) is small[1]
    assert border.tilt(quad(0, 0, 200, 150)) == 0.0 and border.tilt(quad(0, 0, 100, 150, 40)) > 0.3


def test_border_of_a_page():
    photo = np.full((300, 400), 40, np.uint8)
    want = np.array([[70, 50], [330, 60], [320, 255], [80, 245]], float)
    yy, xx = np.mgrid[0:300, 0:400]
    inside = np.ones(photo.shape, bool)
    for k in range(4):
        (x1, y1), (x2, y2) = want[k], want[(k + 1) % 4]
        inside &= (x2 - x1) * (yy - y1) - (y2 - y1) * (xx - x1) >= 0
    photo[inside] = 235
    got = border.page_border(photo)
    assert got is not None and np.abs(got - want).max() < 8
    flat = border.flatten(photo, got)
    assert abs(flat.shape[0] - 195) < 15 and abs(flat.shape[1] - 260) < 15 and (flat > 200).mean() > 0.9


def test_min_cut_and_mixture():
    capacity = {(0, 1): 3.0, (0, 2): 2.0, (1, 2): 1.0, (1, 3): 2.0, (2, 3): 3.0}
    flow, side = regions.min_cut(capacity, 4, 0, 3)
    assert flow == 5.0 and side[0] and not side[3]
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(9, 1, (100, 3))])
    weight, mean, _ = regions.gaussian_mixture(p, 2)
    assert sorted(np.round(weight, 1)) == [0.3, 0.7] and abs(mean.sum() - 27) < 2


@pytest.mark.parametrize("shape", [(1, 6), (6, 1), (2, 2), (5, 7), (8, 8)])
def test_grid_cut_is_the_minimum_cut(shape):
    rng = np.random.default_rng(shape[0] * 10 + shape[1])
    h, w = shape
    n = h * w
    for smooth in (0.1, 1.0, 5.0):
        one, two, _ = regions.grid_edges(np.zeros(shape))
        links, gain = rng.uniform(0, smooth, len(one)), rng.normal(0, 1, n)
        seeds = rng.choice([0, 128, 128, 128, 255], n).astype(np.uint8)
        edges = {}
        for a, b, c in zip(one.tolist(), two.tolist(), links.tolist()):
            edges[a, b] = edges[b, a] = c
        for i in range(n):
            edges[n, i] = 1e9 if seeds[i] == 255 else 0 if seeds[i] == 0 else max(gain[i], 0)
            edges[i, n + 1] = 1e9 if seeds[i] == 0 else 0 if seeds[i] == 255 else max(-gain[i], 0)
        want = regions.min_cut(edges, n + 2, n, n + 1)[1][:n]
        assert (regions.grid_cut(links, gain.reshape(shape), seeds.reshape(shape)).ravel() == want).all()


def test_grab_cut_of_noise_takes_less_than_a_second():
    a = np.random.default_rng(0).integers(0, 256, (64, 64), np.uint8)
    trimap = np.full((64, 64), 128, np.uint8)
    trimap[:8], trimap[24:40, 24:40] = 0, 255
    begin = time.process_time()
    regions.grab_cut(np.repeat(a[..., None], 3, 2), trimap, 2, 5.0)
    assert time.process_time() - begin < 1


def test_grab_cut_separates_colours():
    a = np.full((16, 16, 3), 240, np.uint8)
    a[4:12, 4:12] = (10, 20, 30)
    a = pages.add_gaussian(a, 4, 1)
    trimap = np.full((16, 16), 128, np.uint8)
    trimap[:2], trimap[6:10, 6:10] = 0, 255
    mask = regions.grab_cut(a, trimap, 2, 5.0)
    want = np.zeros((16, 16), bool)
    want[4:12, 4:12] = True
    assert (mask != want).mean() < 0.05


def test_rank_weights_order_pairs():
    up, down = np.array([1.0, 0.0, 2.0]), np.array([0.0, 1.0, 1.0])
    w = regions.rank_weights([(up, down)])
    assert w @ up > w @ down


def test_colour_regions_and_keypoints():
    a = np.full((30, 30, 3), 200, np.uint8)
    a[5:12, 6:16] = (20, 40, 160)
    found = text.color_regions(a, text.RegionParams(least=10, most=200))
    assert [len(r) for r in found] == [70]
    (x, y, d), = text.keypoints(found, 30)
    assert (x, y) == (10.5, 8.0) and 7 < d < 13


def test_asymmetric_fill_and_flood():
    m = np.zeros((4, 4), bool)
    m[0, 3] = m[1, 2] = m[2, 1] = m[3, 0] = True
    assert regions.reached_regions(m).max() == 0 and regions.reached_regions(m[:, ::-1]).max() == 0
    assert regions.flood_from(m, [(2, 1)]).sum() == 4 and not regions.flood_from(m, [(0, 0)]).any()


def test_convolution_matrix():
    rng = np.random.default_rng(1)
    a, k = rng.normal(size=(6, 7)), rng.normal(size=(2, 3))
    want = [[float((a[y : y + 2, x : x + 3] * k).sum()) for x in range(5)] for y in range(5)]
    assert np.allclose((filters.convolution_matrix(k, 6, 7) @ a.ravel()).reshape(5, 5), want)


def test_text_outline_holds_the_block():
    boxes = [(30 + 20 * k, 40 + 25 * r, 15, 18) for r in range(5) for k in range(8)]
    q = border.text_outline(boxes, (300, 300))
    assert q[0].tolist() == [30.0, 40.0] and abs(q[2][0] - 185) < 1e-6 and q[2][1] == 158
    assert border.text_outline(boxes[:1], (300, 300)) is None
