"""Kernels that need a raster's neighbourhoods as a whole: numpy behind Arrow batches, one raster at a time.

Rasters are rows (id, px: row-major array); nothing is exploded or grouped, so a page never leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _each(rasters: DataFrame, key: str, width: int, schema: str, f: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """Rows of f for each raster, its key first."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, px in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if px.is_valid for r in f(px.values.to_numpy(zero_copy_only=False).reshape(-1, width))]
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *[pa.array(c, _arrow(t)) for c, t in zip(columns[1:], [x.split()[1] for x in schema.split(", ")], strict=True)]], [key, *names])

    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, "px").mapInArrow(run, f"{key} {kind}, {schema}")


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}[kind]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of each horizontal run, in order of rows."""
    edges = np.diff(np.pad(mask.astype("i1"), ((0, 0), (1, 1))), axis=1)
    (row, begin), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    return row, begin, end


def _run_components(row: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, neighbours: int) -> np.ndarray:
    """The component of each run, numbered from 1 by their first runs: runs that touch in the next row are united."""
    reach, step = int(neighbours == 8), width + 2
    # runs of a row are ascending, so those that touch a run are a stretch of the next row's
    first = np.searchsorted(row * step + end, (row + 1) * step + begin - reach, "right")
    last = np.searchsorted(row * step + begin, (row + 1) * step + end + reach, "left")
    up = list(range(len(row)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i in np.flatnonzero(last > first).tolist():
        for j in range(int(first[i]), int(last[i])):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return np.unique([root(x) for x in range(len(up))], return_inverse=True)[1] + 1 if up else np.zeros(0, dtype=int)


def labelled(mask: np.ndarray, neighbours: int = 8) -> np.ndarray:
    """Components of a mask, numbered from 1 in order of their first pixels; 0 is background."""
    row, begin, end = _runs(mask)
    label = _run_components(row, begin, end, mask.shape[1], neighbours)
    steps = np.zeros((mask.shape[0], mask.shape[1] + 1), dtype="i8")
    np.add.at(steps, (row, begin), label)
    np.add.at(steps, (row, end), -label)
    return steps.cumsum(1)[:, :-1]


def measured(px: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of each component, from 1: area, x1, y1, x2, y2 (both ends included), sum and max of the pixels; one pass over the pixels."""
    y, x = np.nonzero(label)
    own, n = label[y, x] - 1, int(label.max(initial=0))
    top = max(label.shape)
    out = {"area": np.bincount(own, minlength=n), "sum": np.bincount(own, px[y, x], n)}
    for name, f, values, start in (("x1", np.minimum, x, top), ("y1", np.minimum, y, top), ("x2", np.maximum, x, -1), ("y2", np.maximum, y, -1), ("max", np.maximum, px[y, x], -np.inf)):
        out[name] = np.full(n, start, dtype=float if name == "max" else int)
        f.at(out[name], own, values)
    return out


def components(rasters: DataFrame, key: str, width: int, *, threshold: int = 128, neighbours: int = 8) -> DataFrame:
    """Of the pixels darker than the threshold: label, area, x1, y1, x2, y2, mean."""

    def one(px: np.ndarray) -> list[tuple]:
        m = measured(px, labelled(px < threshold, neighbours))
        return [(i + 1, *[int(m[c][i]) for c in ("area", "x1", "y1", "x2", "y2")], float(m["sum"][i] / m["area"][i])) for i in range(len(m["area"]))]

    return _each(rasters, key, width, "label int, area int, x1 int, y1 int, x2 int, y2 int, mean double", one)


def spread(px: np.ndarray, size: int, f) -> np.ndarray:
    """Minimum or maximum over a square, edges repeated."""
    r = size // 2
    for axis in (0, 1):
        padded = np.pad(px, [(r, size - 1 - r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        px = f([np.take(padded, range(i, i + px.shape[axis]), axis) for i in range(size)], axis=0)
    return px


def opened(px: np.ndarray, size: int) -> np.ndarray:
    return spread(spread(px, size, np.min), size, np.max)


def closed(px: np.ndarray, size: int) -> np.ndarray:
    return spread(spread(px, size, np.max), size, np.min)


def darker_than_around(px: np.ndarray, block: int, offset: float) -> np.ndarray:
    """255 where a pixel is darker than the mean of its block by the offset, else 0; sums come from an integral image."""
    r = block // 2
    p = np.pad(px.astype("f8"), r, mode="edge").cumsum(0).cumsum(1)
    p = np.pad(p, ((1, 0), (1, 0)))
    h, w = px.shape
    mean = (p[block : block + h, block : block + w] - p[:h, block : block + w] - p[block : block + h, :w] + p[:h, :w]) / block**2
    return np.where(px <= mean - offset, 255, 0)


def clean(px: np.ndarray, *, block: int = 5, offset: float = 25, least_area: int = 2, most_mean: float = 128, border: int = 1) -> np.ndarray:
    """Ink on white: locally dark pixels, opened and closed; components that are small or pale go; white border."""
    ink = closed(opened(darker_than_around(px, block, offset), 1), 2)
    label = labelled(ink > 0)
    m = measured(px, label)
    goes = (m["area"] < least_area) | (m["sum"] > most_mean * m["area"])
    out = 255 - np.where(np.append(False, goes)[label], 0, ink)
    out[:border] = out[-border:] = out[:, :border] = out[:, -border:] = 255
    return out


def cleaned(rasters: DataFrame, key: str, width: int, **options) -> DataFrame:
    """Rasters after clean(): px."""
    return _each(rasters, key, width, "px array<int>", lambda px: [(clean(px, **options).reshape(-1).tolist(),)])


def cheapest(cost: np.ndarray, start: int, end: int) -> list[int]:
    """The row at each column of the cheapest way from (start, first) to (end, last), one column and at most one row a step."""
    h, w = cost.shape
    best = np.full(h, np.inf)
    best[start] = cost[start, 0]
    back = np.zeros((h, w), dtype=int)
    for x in range(1, w):
        before = np.stack([np.concatenate(([np.inf], best[:-1])), best, np.concatenate((best[1:], [np.inf]))])
        pick = before.argmin(0)
        back[:, x] = np.arange(h) + pick - 1
        best = before[pick, np.arange(h)] + cost[:, x]
    way = [end]
    for x in range(w - 1, 0, -1):
        way.append(int(back[way[-1], x]))
    return way[::-1]


def cheapest_paths(rasters: DataFrame, key: str, width: int) -> DataFrame:
    def one(px: np.ndarray) -> list[tuple]:
        way = cheapest(px.astype("f8"), len(px) // 2, len(px) // 2)
        return [(way, float(px[way, range(len(way))].sum()))]

    return _each(rasters, key, width, "way array<int>, cost double", one)


def shortest(cost: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]] | None:
    """The pixels of the cheapest way between two, by steps to any of the eight neighbours, back as well; its cost is that of the pixels after the first.

    Costs mustn't be negative; pixels of infinite cost are walls; None if there's no way. Ties go to the way found by the smaller pixel.
    """
    import heapq

    h, w = cost.shape
    best, back, done = {start: 0.0}, {}, set()
    todo = [(0.0, start)]
    while todo:
        so_far, (y, x) = heapq.heappop(todo)
        if (y, x) == end:
            way = [end]
            while way[-1] != start:
                way.append(back[way[-1]])
            return way[::-1]
        if (y, x) in done:
            continue
        done.add((y, x))
        for i in range(max(0, y - 1), min(h, y + 2)):
            for j in range(max(0, x - 1), min(w, x + 2)):
                total = so_far + float(cost[i, j])
                if (i, j) not in done and total < best.get((i, j), np.inf):
                    best[i, j], back[i, j] = total, (y, x)
                    heapq.heappush(todo, (total, (i, j)))
    return None


def shortest_paths(rasters: DataFrame, key: str, width: int) -> DataFrame:
    """rows, columns, cost of the cheapest way through the ink, dark pixels being dear, from the middle of the left edge to that of the right one."""

    def one(px: np.ndarray) -> list[tuple]:
        ink = 255.0 - px
        way = shortest(ink, (len(px) // 2, 0), (len(px) // 2, width - 1))
        return [([y for y, _ in way], [x for _, x in way], float(sum(ink[p] for p in way[1:])))]

    return _each(rasters, key, width, "rows array<int>, columns array<int>, cost double", one)


def otsu(px: np.ndarray) -> int:
    """The threshold with the greatest variance between the classes up to it and above it; the smallest of equal ones."""
    values, counts = np.unique(px, return_counts=True)
    w, m = counts.cumsum().astype("f8"), (values * counts).cumsum().astype("f8")
    rest = np.maximum(w[-1] - w, 1)
    between = np.where(w < w[-1], (m * w[-1] - m[-1] * w) ** 2 / (w * rest), 0)
    return int(values[between.argmax()])


def _cuts(ink: np.ndarray, least_band: int, inner: bool) -> list[tuple[int, int]]:
    """First and last row of the cheapest way through each band of more rows than least_band; inner: only of those off the edges."""
    profile = ink.sum(1)
    low = np.flatnonzero(profile < (profile.max() - profile.min()) / 2 + profile.min())
    bands = np.split(low, np.flatnonzero(np.diff(low) > 1) + 1) if len(low) else []
    cuts = []
    for band in bands:
        if len(band) <= least_band or (inner and (band[0] == 0 or band[-1] == len(ink) - 1)):
            continue
        part = ink[band[0] : band[-1] + 1].astype("f8")
        way = cheapest(part, len(part) // 2, len(part) // 2)
        cuts.append((band[0] + min(way), band[0] + max(way)))
    return cuts


def _between(cuts: list[tuple[int, int]], rows: int) -> list[tuple[int, int]]:
    tops = [0, *[a for a, _ in cuts]]
    ends = [*[b for _, b in cuts], rows]
    return [(int(a), int(b)) for a, b in zip(tops, ends, strict=True) if b > a]


def segment(px: np.ndarray, *, least_band: int = 10, least_inner: int = 3) -> list[tuple[int, int]]:
    """First and end row of each text line: cut at the cheapest ways through the bands where the profile of ink is low.

    Ink is what's up to Otsu's threshold; bands have more than ``least_band`` rows. Lines higher than the 90th
    percentile are cut once more, at inner bands of more than ``least_inner`` rows.
    """
    ink = (px <= otsu(px)).astype(int)
    lines = _between(_cuts(ink, least_band, False), len(px))
    tall = np.percentile([b - a for a, b in lines], 90)
    out = []
    for a, b in lines:
        parts = [(0, b - a)]
        if b - a > tall:
            own = (px[a:b] <= otsu(px[a:b])).astype(int)
            parts = _between(_cuts(own, least_inner, True), b - a)
        out += [(a + x, a + y) for x, y in parts]
    return out


def segmented(rasters: DataFrame, key: str, width: int, **options) -> DataFrame:
    return _each(rasters, key, width, "line int, first_row int, end_row int", lambda px: [(i, a, b) for i, (a, b) in enumerate(segment(px, **options))])


def resized(px: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * px.shape[0] / h - 0.5, 0, px.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * px.shape[1] / w - 0.5, 0, px.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, px.shape[0] - 1), np.minimum(x0 + 1, px.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    p = px.astype("f8")
    return p[y0][:, x0] * (1 - fy) * (1 - fx) + p[y1][:, x0] * fy * (1 - fx) + p[y0][:, x1] * (1 - fy) * fx + p[y1][:, x1] * fy * fx


def rotated(px: np.ndarray, degrees: float, fill: int = 0) -> np.ndarray:
    """About the centre, nearest pixel, on a canvas that holds all of it."""
    t = np.deg2rad(degrees)
    s, c = np.sin(t), np.cos(t)
    h, w = px.shape
    nh, nw = int(h * abs(c) + w * abs(s) + 0.5), int(h * abs(s) + w * abs(c) + 0.5)
    y, x = np.mgrid[:nh, :nw]
    y, x = y - (nh - 1) / 2, x - (nw - 1) / 2
    sx, sy = np.rint(c * x - s * y + (w - 1) / 2).astype(int), np.rint(s * x + c * y + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full((nh, nw), fill)
    out[inside] = px[sy[inside], sx[inside]]
    return out


def unsharp(px: np.ndarray, amount: float = 1.5) -> np.ndarray:
    """amount times the image less (amount - 1) times its 3 by 3 mean, saturated."""
    p = np.pad(px.astype("f8"), 1, mode="edge")
    blur = sum(p[i : i + px.shape[0], j : j + px.shape[1]] for i in range(3) for j in range(3)) / 9
    return np.clip(np.rint(amount * px - (amount - 1) * blur), 0, 255).astype(int)


def ctc_cost(log_p: np.ndarray, label: list[int], blank: int) -> float:
    """Minus the log probability of a label, over all alignments: the forward pass in log space."""
    s = [blank, *[x for c in label for x in (c, blank)]]
    a = np.full(len(s), -np.inf)
    a[0] = log_p[0, blank]
    if len(s) > 1:
        a[1] = log_p[0, s[1]]
    for t in range(1, len(log_p)):
        b = a.copy()
        b[1:] = np.logaddexp(b[1:], a[:-1])
        for i in range(2, len(s)):
            if s[i] != blank and s[i] != s[i - 2]:
                b[i] = np.logaddexp(b[i], a[i - 2])
        a = b + log_p[t, s]
    return float(-np.logaddexp(a[-1], a[-2])) if len(s) > 1 else float(-a[-1])


def ctc_costs(samples: DataFrame, key: str, blank: int) -> DataFrame:
    """samples: key, steps (arrays of log probabilities), label (array of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [ctc_cost(np.array(s), y, blank) for s, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.float64())], [key, "cost"])

    return samples.select(key, F.col("steps"), F.col("label")).mapInArrow(run, f"{key} {samples.schema[key].dataType.simpleString()}, cost double")
