"""A text detector's score maps to boxes and polygons, and points through projective maps.

Score maps are rows (id, h, w, text, link: row-major arrays of doubles); a page's maps never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import labelled, measured, spread


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise in mathematical axes."""
    p = np.unique(points, axis=0).astype("f8")
    if len(p) < 3:
        return p

    def chain(rows) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def smallest_rectangle(points: np.ndarray) -> np.ndarray:
    """The four corners of the rectangle of least area around points; one of its sides lies on a side of their hull."""
    corners = hull(points)
    if len(corners) == 1:
        return np.repeat(corners, 4, axis=0)
    sides = np.roll(corners, -1, axis=0) - corners
    along = sides / np.hypot(*sides.T)[:, None]
    across = along[:, ::-1] * [-1, 1]
    u, v = corners @ along.T, corners @ across.T
    best = ((u.max(0) - u.min(0)) * (v.max(0) - v.min(0))).argmin()
    a, b, ends = along[best], across[best], (u[:, best], v[:, best])
    return np.array([a * x + b * y for x, y in ((ends[0].min(), ends[1].min()), (ends[0].max(), ends[1].min()), (ends[0].max(), ends[1].max()), (ends[0].min(), ends[1].max()))])


def clockwise_from_top_left(box: np.ndarray) -> np.ndarray:
    """A box's corners clockwise on the screen, from the one with the smallest sum."""
    d = box - box.mean(0)
    box = box[np.argsort(np.arctan2(d[:, 1], d[:, 0]), kind="stable")]
    return np.roll(box, -int(box.sum(1).argmin()), axis=0)


def oriented_boxes(text: np.ndarray, link: np.ndarray, *, text_least: float = 0.4, link_least: float = 0.4, peak_least: float = 0.7, least_area: int = 10, square: float = 0.1) -> list[np.ndarray]:
    """The boxes of words: 4-connected components of either map that are large enough and have a peak of text.

    Pixels that only link go, what is left grows with the component's size, and the smallest rectangle around it is the
    box; of nearly square ones the upright rectangle.
    """
    either = labelled((text >= text_least) | (link >= link_least), 4)
    m, out = measured(text, either), []
    only_link = (link >= link_least) & (text < text_least)
    for n in np.flatnonzero((m["area"] >= least_area) & (m["max"] >= peak_least)):
        w, h = int(m["x2"][n] - m["x1"][n] + 1), int(m["y2"][n] - m["y1"][n] + 1)
        grow = int(np.sqrt(m["area"][n] * min(w, h) / (w * h)) * 2)
        x, y = max(0, m["x1"][n] - grow), max(0, m["y1"][n] - grow)
        part = slice(y, min(text.shape[0], m["y2"][n] + grow + 2)), slice(x, min(text.shape[1], m["x2"][n] + grow + 2))
        own = np.where((either[part] == n + 1) & ~only_link[part], 1, 0)
        own = spread(np.pad(own, grow + 1), 1 + grow, np.max)[grow + 1 : -grow - 1, grow + 1 : -grow - 1] if grow else own
        ys, xs = np.nonzero(own)
        if not len(xs):
            continue
        points = np.stack((xs + x, ys + y), axis=1)
        box = smallest_rectangle(points)
        sides = np.hypot(*(box[1] - box[0])), np.hypot(*(box[2] - box[1]))
        if abs(1 - max(sides) / (min(sides) + 1e-5)) <= square:
            (l, t), (r, b) = points.min(0), points.max(0)
            box = np.array([[l, t], [r, t], [r, b], [l, b]], dtype="f8")
        out.append(clockwise_from_top_left(box))
    return out


def projective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 by 3 map that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, dtype="f8"), np.array(right, dtype="f8")), 1).reshape(3, 3)


def mapped(points: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Points through a projective map."""
    p = np.column_stack((points, np.ones(len(points)))) @ m.T
    return p[:, :2] / p[:, 2:]


def text_polygon(mask: np.ndarray, box: np.ndarray, pivots: int = 5) -> np.ndarray | None:
    """The outline of a bent word: 2 * pivots + 4 points clockwise, or None where the box has to do.

    The box is laid flat; in each of 2 * pivots + 1 stretches of its length the middle of the text's height is taken.
    Pivots are the stretches between two that also hold the tallest column; through each goes a line square to the way
    the middles go, as long as the text is high; the two ends are carried on to the edges of the text.
    """
    w, h = (int(max(np.hypot(*(box[i + 1] - box[i])), np.hypot(*(box[(i + 3) % 4] - box[(i + 2) % 4])))) for i in (0, 1))
    stretches = 2 * pivots + 1
    if w < stretches or h < 2:
        return None
    flat = projective(box, np.array([[0, 0], [w, 0], [w, h], [0, h]]))
    y, x = np.mgrid[:h, :w]
    back = np.rint(mapped(np.column_stack((x.ravel(), y.ravel())), np.linalg.inv(flat))).astype(int)
    inside = (back[:, 0] >= 0) & (back[:, 0] < mask.shape[1]) & (back[:, 1] >= 0) & (back[:, 1] < mask.shape[0])
    word = np.zeros(h * w, dtype=bool)
    word[inside] = mask[back[inside, 1], back[inside, 0]]
    word = word.reshape(h, w)
    held = np.flatnonzero(word.any(0))
    if len(held) < stretches:
        return None
    top, bottom = word.argmax(0), h - 1 - word[::-1].argmax(0)
    middle, height = (top + bottom) / 2, bottom - top + 1
    parts = [held[(held >= w * i / stretches) & (held < w * (i + 1) / stretches)] for i in range(stretches)]
    if any(not len(p) for p in parts):
        return None
    centres = [(p.mean(), middle[p].mean()) for p in parts]
    tallest = [p[height[p].argmax()] for p in parts[1::2]]
    half = float(np.median(height[tallest])) / 2
    if half < 0.5:
        return None
    way = [(centres[i + 1][0] - centres[i - 1][0], centres[i + 1][1] - centres[i - 1][1]) for i in range(1, stretches, 2)]
    square = [np.array([-dy, dx]) / np.hypot(dx, dy) for dx, dy in way]
    at = [np.array([float(t), np.interp(t, [c[0] for c in centres], [c[1] for c in centres])]) for t in tallest]
    starts = [at[0] + np.array(way[0]) / way[0][0] * (held[0] - at[0][0]), at[-1] + np.array(way[-1]) / way[-1][0] * (held[-1] - at[-1][0])]
    spine = [starts[0], *at, starts[1]]
    normals = [square[0], *square, square[-1]]
    upper = [p - n * half for p, n in zip(spine, normals, strict=True)]
    lower = [p + n * half for p, n in zip(spine, normals, strict=True)]
    return mapped(np.array(upper + lower[::-1]), np.linalg.inv(flat))


def detected(maps: DataFrame, key: str, *, polygons: bool = False, **options) -> DataFrame:
    """key, ord, poly (x, y, x, y, ...): a row for each word, its box, or its outline where polygons are wanted and one is found.

    Null maps, and maps without text, give no rows.
    """
    kind = maps.schema[key].dataType.simpleString()
    least = options.get("text_least", 0.4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, w, text, link in zip(*[batch.column(i) for i in range(4)], strict=True):
                if not (text.is_valid and link.is_valid and len(text)):
                    continue
                t, n = (x.values.to_numpy(zero_copy_only=False).reshape(-1, w.as_py()) for x in (text, link))
                for i, box in enumerate(oriented_boxes(t, n, **options)):
                    own = text_polygon(t >= least, box) if polygons else None
                    rows.append((k.as_py(), i, (box if own is None else own).reshape(-1).tolist()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.float64()))], [key, "ord", "poly"])

    return maps.select(key, "w", "text", "link").mapInArrow(run, f"{key} {kind}, ord int, poly array<double>")
