"""Page preparation, detection and decoding: against brute force and hand-made pages."""

import itertools
import random
from functools import partial

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import detect, kernels, prepare, recognise, splits


def rng():
    return np.random.default_rng(5)


def test_sharpened_by_brute_force():
    px = rng().integers(0, 256, (9, 7))
    got = prepare.sharpened(px, 2.0)
    for y in range(9):
        for x in range(7):
            want = px[y, x]
            if 0 < y < 8 and 0 < x < 6:
                around = sum(int(px[y + i, x + j]) * (5 if i == j == 0 else 1) for i in (-1, 0, 1) for j in (-1, 0, 1))
                smooth = int(around / 13 + 0.5)
                want = min(255, max(0, 2 * int(px[y, x]) - smooth))
            assert got[y, x] == want
    assert (prepare.sharpened(px[:2]) == px[:2]).all()


def lines_page(h=120, w=200):
    px = np.full((h, w), 255)
    for y in range(15, h - 10, 14):
        px[y : y + 4, 12 : w - 12] = 0
    return px


def test_skew_is_found_and_turned_back():
    px = lines_page()
    assert prepare.skew(px) == 0.0
    assert prepare.skew(np.full((5, 5), 255)) is None
    for angle in (-4.0, 2.5):
        turned = kernels.rotated(px, angle, 255)
        assert abs(prepare.skew(turned) - angle) <= 0.35
        upright = prepare.deskewed(turned, fill=255)
        rows = (upright < 128).sum(1)
        assert rows.max() > 0.9 * (200 - 24)


def test_borders_and_rules():
    px = np.full((150, 160), 255)
    px[20, 5:150] = 0
    px[10:140, 30] = 0
    px[60:66, 60:80] = 0
    got = prepare.without_borders(px, thick=3)
    assert (got[60:66, 60:80] == 0).all() and (got[20] == 255).all() and (got[:, 30] == 255).all()
    ruled = np.full((40, 90), 200)
    ruled[20] = 30
    ruled[10:32, 40:43] = 30
    got = prepare.without_rules(ruled, smooth=1)
    assert (got[20, :35] == 255).all() and (got[20, 50:] == 255).all()
    assert (got[10:32, 41] == 0).all()
    assert (prepare.without_rules(np.full((4, 4), 7)) == 255).all()


def test_regions_and_masks():
    px = np.full((100, 80), 255)
    mask = np.zeros((50, 40))
    mask[10:20, 5:30] = 1.0
    mask[40, 38] = 1.0
    x1, y1, x2, y2 = prepare.text_region(px, mask, pad=3)
    assert abs(x1 - 7) <= 2 and abs(y1 - 17) <= 2 and abs(x2 - 63) <= 2 and abs(y2 - 43) <= 2
    assert prepare.text_region(px, np.zeros((5, 5))) is None
    spot = np.zeros((9, 30), dtype=int)
    spot[4, 12] = 255
    y, x = np.nonzero(prepare.mask_levels(spot))
    assert (y.min(), y.max(), x.min(), x.max()) == (3, 6, 5, 20)
    dark = prepare.noisy(px, 1)
    assert (dark == prepare.noisy(px, 1)).all() and dark.max() <= 255 and 5 < (255 - dark).mean() < 15
    assert prepare.fitted(px).shape == (40, 200) and prepare.narrowed(np.zeros((10, 2048), dtype=int)).shape == (5, 1024)
    assert (prepare.evened(np.full((3, 3), 7)) == 255).all()


def test_chain_and_crops(spark):
    rows = [(1, 4, list(range(8))), (2, 2, list(range(8))), (3, 2, None), (4, 2, [])]
    pages = spark.createDataFrame(rows, "k long, w int, px array<int>")
    got = {r["k"]: (r["h"], r["w"], r["px"]) for r in prepare.chained(pages, "k", [np.fliplr, lambda p: p + 1]).collect()}
    assert got == {1: (2, 4, [4, 3, 2, 1, 8, 7, 6, 5]), 2: (4, 2, [2, 1, 4, 3, 6, 5, 8, 7]), 3: (None, 2, None), 4: (0, 2, [])}
    sides = {(r["k"], r["side"]): (r["w"], r["px"]) for r in prepare.halved(pages.where("k < 3"), "k").collect()}
    assert sides == {(1, "left"): (2, [0, 1, 4, 5]), (1, "right"): (2, [2, 3, 6, 7]), (2, "whole"): (2, list(range(8)))}
    boxes = spark.createDataFrame([(1, -3, 1, 2, 9, "a"), (1, 5, 0, 9, 2, "outside")], "k long, x1 int, y1 int, x2 int, y2 int, note string")
    r = prepare.cropped(pages, boxes, "k").collect()
    assert [(x["note"], x["h"], x["w"], x["px"]) for x in r] == [("a", 1, 2, [4, 5])]
    done = prepare.prepared(spark.createDataFrame([(k, 60, lines_page(40, 60).reshape(-1).tolist()) for k in (2, 1)], "k long, w int, px array<int>"), "k", skew_options={"most": 1.0}).orderBy("number").collect()
    assert [(x["number"], x["k"], x["side"]) for x in done] == [(0, 1, "left"), (1, 1, "right"), (2, 2, "left"), (3, 2, "right")]
    assert all(len(x["px"]) == x["h"] * x["w"] for x in done)
    assert prepare.finished(pages.where("k < 3"), "k").count() == 2


def test_components_by_flood_fill():
    r = rng()
    for _ in range(60):
        mask = r.random((r.integers(1, 10), r.integers(1, 10))) < r.random()
        for n in (4, 8):
            label, want, c = kernels.labelled(mask, n), np.zeros(mask.shape, dtype=int), 0
            for y, x in zip(*np.nonzero(mask), strict=True):
                if not want[y, x]:
                    c, todo = c + 1, [(y, x)]
                    want[y, x] = c
                    while todo:
                        a, b = todo.pop()
                        for i, j in itertools.product((-1, 0, 1), repeat=2):
                            if (n == 8 or not (i and j)) and 0 <= a + i < mask.shape[0] and 0 <= b + j < mask.shape[1] and mask[a + i, b + j] and not want[a + i, b + j]:
                                want[a + i, b + j] = c
                                todo.append((a + i, b + j))
            assert (label == want).all()


def test_clean_by_brute_force():
    r = rng()
    px = np.where(r.random((30, 40)) < 0.2, r.integers(0, 90, (30, 40)), 230)
    ink = kernels.closed(kernels.opened(kernels.darker_than_around(px, 5, 25), 1), 2)
    label = kernels.labelled(ink > 0)
    for n in range(1, label.max() + 1):
        if (label == n).sum() < 2 or px[label == n].mean() > 128:
            ink[label == n] = 0
    want = 255 - ink
    want[0] = want[-1] = want[:, 0] = want[:, -1] = 255
    assert (kernels.clean(px) == want).all()


def test_smallest_rectangle():
    r = rng()
    for _ in range(30):
        points = r.integers(0, 30, (r.integers(3, 20), 2))
        box = detect.smallest_rectangle(points)
        u, v = box[1] - box[0], box[3] - box[0]
        if not (np.hypot(*u) and np.hypot(*v)):
            continue
        area = np.hypot(*u) * np.hypot(*v)
        angles = np.deg2rad(np.arange(0, 90, 0.25))
        turned = points @ np.array([[np.cos(angles), -np.sin(angles)], [np.sin(angles), np.cos(angles)]]).transpose(2, 0, 1)
        assert area <= (np.ptp(turned[..., 0], axis=1) * np.ptp(turned[..., 1], axis=1)).min() + 1e-6
        inside = (points - box[0]) @ np.stack((u / (u @ u), v / (v @ v))).T
        assert inside.min() > -1e-9 and inside.max() < 1 + 1e-9


def test_words_are_found(spark):
    text, link = np.zeros((40, 80)), np.zeros((40, 80))
    text[10:16, 10:50] = 0.9
    text[30, 70] = 0.9  # too small
    text[20:26, 5:20] = 0.5  # no peak
    (box,) = detect.oriented_boxes(text, link)
    assert box[0].sum() == box.sum(1).min()
    assert box[:, 0].min() <= 10 and box[:, 0].max() >= 49 and box[:, 1].min() <= 10 and box[:, 1].max() >= 15
    assert np.ptp(box[:, 0]) < 50 and np.ptp(box[:, 1]) < 18
    square = np.zeros((40, 40))
    square[10:20, 10:20] = 0.9
    (box,) = detect.oriented_boxes(square, np.zeros((40, 40)))
    assert (np.sort(np.unique(box[:, 0])) == np.unique(box[:, 0])).all() and len(np.unique(box)) == 2
    linked = text.copy()
    linked[10:16, 49:60] = 0
    bridge = np.zeros((40, 80))
    bridge[12:14, 49:60] = 0.9
    linked[10:16, 60:75] = 0.9
    assert len(detect.oriented_boxes(linked, bridge)) == 1 and len(detect.oriented_boxes(linked, link)) == 2
    maps = spark.createDataFrame([(1, 80, text.reshape(-1).tolist(), link.reshape(-1).tolist()), (2, 80, None, None)], "k long, w int, text array<double>, link array<double>")
    assert [(r["k"], r["ord"], len(r["poly"])) for r in detect.detected(maps, "k").collect()] == [(1, 0, 8)]


def test_outline_of_a_bent_word():
    y, x = np.mgrid[:80, :220]
    middle = 40 + 12 * np.sin(x / 35)
    mask = (np.abs(y - middle) <= 6) & (x >= 20) & (x < 200)
    box = detect.clockwise_from_top_left(detect.smallest_rectangle(np.argwhere(mask)[:, ::-1]))
    poly = detect.text_polygon(mask, box)
    assert poly.shape == (14, 2)
    for px, py in poly[1:6]:
        assert abs(py - (40 + 12 * np.sin(px / 35)) + 6) < 4
    for px, py in poly[8:13]:
        assert abs(py - (40 + 12 * np.sin(px / 35)) - 6) < 4
    assert detect.text_polygon(mask, box[:, :] * 0 + [[0, 0], [5, 0], [5, 5], [0, 5]]) is None
    m = detect.projective(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[2, 3], [5, 3], [6, 8], [1, 9]]))
    assert np.allclose(detect.mapped(np.array([[0, 0], [1, 1]]), m), [[2, 3], [6, 8]])


def test_beam_search():
    table = np.log(np.random.default_rng(2).dirichlet(np.ones(4), size=(4, 4)))

    def scores(beginnings):
        return np.array([table[b[-1], b[-2] if len(b) > 1 else 0] for b in beginnings])

    def whole(seq):
        full, total = [0], 0.0
        for t in seq:
            total += scores([full])[0][t]
            full.append(t)
        return total

    every = [s for n in range(1, 5) for s in itertools.product(range(4), repeat=n) if 3 not in s[:-1] and (s[-1] == 3 or n == 4)]
    best = max(every, key=lambda s: (whole(s), [-t for t in s]))
    assert recognise.beam_search(scores, 0, 3, beams=500, steps=4) == list(best)
    greedy = recognise.beam_search(scores, 0, 3, beams=1, steps=4)
    assert whole(greedy) <= whole(best)


def test_engine_boxes_and_names(spark):
    pages = spark.createDataFrame([(1, 2, [0, 1, 2, 3]), (2, 2, None)], "page_id long, w int, px array<int>")
    got = recognise.word_boxes(pages, lambda: lambda px: [(5, 0, 0, px.shape[1], px.shape[0]), (4, 0, 0, 1, 1)])
    assert sorted(map(tuple, got.collect())) == [(1, 4, 0, 0, 1, 1), (1, 5, 0, 0, 2, 2)]
    assert splits.variants(spark.createDataFrame([("a",)], "s string"), "s", ["x", "y"]).select("file").orderBy("variant").toPandas()["file"].tolist() == ["a.png", "a_x.png", "a_y.png"]


def test_noise_and_sizes_in_a_chain(spark):
    random.seed(1)
    pages = spark.createDataFrame([(1, 30, [200] * 900)], "k long, w int, px array<int>")
    out = prepare.chained(pages, "k", [partial(prepare.noisy, seed=3), partial(prepare.narrowed, most=10)]).first()
    assert (out["h"], out["w"]) == (10, 10) and max(out["px"]) <= 200
    assert prepare.chained(pages, "k", []).select(F.size("px")).first()[0] == 900
