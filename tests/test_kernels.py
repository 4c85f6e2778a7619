import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from vellum.functions import raster as R
from vellum.operators import kernels


def flood(mask, eight):
    seen, parts = np.zeros(mask.shape, bool), []
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    for y, x in itertools.product(*map(range, mask.shape)):
        if mask[y, x] and not seen[y, x]:
            todo, own = [(y, x)], set()
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                own.add((a, b))
                for dy, dx in steps:
                    c, d = a + dy, b + dx
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
            parts.append(own)
    return parts


def test_components():
    rng = np.random.default_rng(1)
    for _ in range(60):
        mask = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.5
        for n in (4, 8):
            label = kernels.labelled(mask, n)
            got = [set(zip(*map(list, np.nonzero(label == i)), strict=True)) for i in range(1, label.max() + 1)]
            assert [{(int(a), int(b)) for a, b in g} for g in got] == flood(mask, n == 8)


def test_cheapest_path():
    rng = random.Random(2)
    for _ in range(20):
        h, w = rng.randint(1, 4), rng.randint(1, 5)
        cost = np.array([[rng.randint(0, 9) for _ in range(w)] for _ in range(h)], float)
        m = h // 2
        ways = [p for p in itertools.product(range(h), repeat=w) if p[0] == p[-1] == m and all(abs(a - b) <= 1 for a, b in zip(p, p[1:], strict=False))]
        way = kernels.cheapest(cost, m, m)
        assert tuple(way) in ways
        assert cost[way, range(w)].sum() == min(cost[list(p), range(w)].sum() for p in ways)


def test_ctc_cost():
    rng = np.random.default_rng(3)
    log_p = np.log(rng.dirichlet(np.ones(3), 4))
    for label in ([], [0], [0, 1], [1, 1]):
        total = 0.0
        for path in itertools.product(range(3), repeat=4):
            said = [k for k, _ in itertools.groupby(path)]
            if [k for k in said if k != 2] == label:
                total += np.exp(log_p[range(4), list(path)].sum())
        assert abs(kernels.ctc_cost(log_p, label, 2) + np.log(total)) < 1e-9


def test_morphology_and_sizes():
    px = np.zeros((5, 5), int)
    px[2, 2] = 255
    assert kernels.opened(px, 3).max() == 0 and (kernels.spread(px, 3, np.max)[1:4, 1:4] == 255).all()
    assert kernels.resized(np.full((3, 4), 7), 6, 2).tolist() == [[7.0] * 2] * 6
    assert kernels.rotated(np.arange(6).reshape(2, 3), 0).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert kernels.rotated(np.ones((4, 4), int), 45).shape == (6, 6)
    assert (kernels.unsharp(np.full((3, 3), 9)) == 9).all()


def test_otsu(spark):
    rows = [([9] * 4,), ([1],), ([0, 0, 200, 210],), ([5, 6, 7, 250],)]
    got = [r["t"] for r in spark.createDataFrame(rows, "px array<int>").select(R.otsu(F.col("px")).alias("t")).collect()]
    assert got == [9, 1, 0, 7]
    for (px,), t in zip(rows, got, strict=True):
        assert min(px) <= t <= max(px)


def test_null_raster(spark):
    df = spark.createDataFrame([(1, None), (2, [0] * 8)], "id int, px array<int>")
    assert [r["id"] for r in kernels.components(df, "id", 4).collect()] == [2]


def test_tall_page_segments():
    page = np.full((300, 60), 200)
    lines = [(20, 40), (60, 80), (100, 120), (126, 146), (170, 190), (210, 230), (250, 270)]  # 6 rows between the third and the fourth
    for a, b in lines:
        page[a:b, 5:55] = 40
    page[65:70] = 200  # 5 rows within a line: no band
    got = kernels.segment(page)
    inside = [[i for i, (a, b) in enumerate(lines) if x <= a and b <= y] for x, y in got]
    assert [i for i in inside if i] == [[0], [1], [2], [3], [4], [5], [6]]
    assert [i for x, y in kernels.segment(page, least_inner=6) if (i := [k for k, (a, b) in enumerate(lines) if x <= a and b <= y])] == [[0], [1], [2, 3], [4], [5], [6]]


def test_segments_see_ink_by_otsu():
    page = np.full((80, 40), 255)
    page[40:60] = 0
    page[10:20] = 160  # a stain, above the threshold
    page[0:36] -= 60
    rng = np.random.default_rng(1)
    for px in (page, rng.integers(0, 256, (20, 20)), np.full((9, 8), 7)):
        t = kernels.otsu(px)
        assert kernels.segment(px) == kernels.segment(np.where(px <= t, 0, 255))


def test_otsu_is_the_column_functions(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice((rng.randint(0, 90), rng.randint(120, 255))) for _ in range(64)]) for i in range(20)] + [(20, [5] * 64)]
    got = spark.createDataFrame(rows, "id int, px array<int>").select("id", R.otsu(F.col("px")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {i: kernels.otsu(np.array(px)) for i, px in rows}


def test_shortest_way_by_relaxation():
    r = np.random.default_rng(4)
    for _ in range(40):
        h, w = r.integers(2, 7, 2)
        cost = r.integers(0, 9, (h, w)).astype("f8")
        cost[r.random((h, w)) < 0.2] = np.inf
        start, end = (0, 0), (h - 1, w - 1)
        far = np.full((h, w), np.inf)
        far[start] = 0
        for _ in range(h * w):
            for y in range(h):
                for x in range(w):
                    near = far[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].min()
                    far[y, x] = min(far[y, x], near + cost[y, x])
        way = kernels.shortest(cost, start, end)
        if np.isinf(far[end]):
            assert way is None
        else:
            assert way[0] == start and way[-1] == end and sum(cost[p] for p in way[1:]) == far[end]
            assert all(max(abs(a - c), abs(b - d)) <= 1 for (a, b), (c, d) in zip(way, way[1:], strict=False))
