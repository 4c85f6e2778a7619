"""Scanned pages made ready for recognition: rasters of any size to rasters, a chain of steps in one task.

Pages are rows (key, w, px: row-major array, 0 black to 255 white). A step is a function from an array of pixels to one;
``chained`` runs all steps of a page behind one Arrow batch, so nothing is written between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import clean, closed, labelled, measured, opened, otsu, resized, rotated, spread, unsharp

Step = Callable[[np.ndarray], np.ndarray]


def whole(px: np.ndarray) -> np.ndarray:
    """Rounded and saturated."""
    return np.clip(np.rint(px), 0, 255).astype(int)


def sharpened(px: np.ndarray, factor: float = 2.0) -> np.ndarray:
    """Away from the smooth image (3 by 3, the middle counts five times) by the factor; the outer pixels stay."""
    if min(px.shape) < 3:
        return px
    p = px.astype("f8")
    h, w = px.shape
    around = sum(p[i : i + h - 2, j : j + w - 2] for i in range(3) for j in range(3))
    smooth = p.copy()
    smooth[1:-1, 1:-1] = np.floor((around + 4 * p[1:-1, 1:-1]) / 13 + 0.5)
    return whole(smooth + factor * (p - smooth))


def skew(px: np.ndarray, *, most: float = 10.0, step: float = 0.1, threshold: int = 128) -> float | None:
    """The angle by which lines of ink climb, in degrees: the one at which rows of ink stand out most; None without ink.

    Found in steps of a degree, then of ``step`` around the best.
    """
    y, x = np.nonzero(px < threshold)
    if len(y) < 2:
        return None

    def sharpness(angle: float) -> float:
        t = np.deg2rad(angle)
        rows = np.bincount(np.floor(y * np.cos(t) + x * np.sin(t) + px.shape[1]).astype(int), minlength=1).astype("f8")
        return float((np.diff(rows) ** 2).sum())

    best = max(np.arange(-most, most + 0.5, 1.0), key=lambda a: (sharpness(a), -abs(a)))
    return float(round(max(np.arange(best - 1, best + 1 + step / 2, step), key=lambda a: (sharpness(a), -abs(a))), 6))


def deskewed(px: np.ndarray, *, fill: int = 0, **options) -> np.ndarray:
    """Turned back by its skew, on a canvas that holds all of it; without ink as it is."""
    angle = skew(px, **options)
    return px if not angle else rotated(px, -angle, fill)


def _long_runs(ink: np.ndarray, length: int) -> np.ndarray:
    """Pixels in horizontal runs of at least that length: an opening by a line."""
    edges = np.diff(np.pad(ink.astype("i1"), ((0, 0), (1, 1))), axis=1)
    (row, begin), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    keep = end - begin >= length
    steps = np.zeros((ink.shape[0], ink.shape[1] + 1), dtype=int)
    np.add.at(steps, (row[keep], begin[keep]), 1)
    np.add.at(steps, (row[keep], end[keep]), -1)
    return steps.cumsum(1)[:, :-1] > 0


def without_borders(px: np.ndarray, *, length: int = 100, gap: int = 10, thick: int = 10, threshold: int = 128) -> np.ndarray:
    """Long straight lines painted white: runs of ink of ``length`` either way, bridged over gaps, ``thick`` pixels wide."""
    ink = px < threshold
    lines = _long_runs(ink, length) | _long_runs(ink.T, length).T
    bridged = closed(np.where(lines, 255, 0), gap) > 0
    label = labelled(bridged)
    m = measured(px, label)
    straight = np.maximum(m["x2"] - m["x1"], m["y2"] - m["y1"]) + 1 >= length
    return np.where(spread(np.where(np.append(False, straight)[label], 1, 0), thick, np.max) > 0, 255, px)


def without_rules(px: np.ndarray, *, length: int = 40, smooth: int = 3) -> np.ndarray:
    """Ruling lines taken out of the page and the strokes that they cross mended, ink black on white.

    Noise is taken out by a mean over ``smooth`` pixels where the pixel is near it, ink is what Otsu's threshold finds,
    rules are runs of ``length`` and more.
    """
    r = smooth // 2
    p = np.pad(px.astype("f8"), r, mode="edge")
    mean = sum(p[i : i + px.shape[0], j : j + px.shape[1]] for i in range(smooth) for j in range(smooth)) / smooth**2
    calm = np.where(np.abs(px - mean) < 30, mean, px)
    ink = calm <= otsu(whole(calm)) if calm.min() < calm.max() else np.zeros(px.shape, dtype=bool)
    rules = _long_runs(ink, length)
    left = ink & ~rules
    cross = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    shifted = lambda m, dy, dx: np.pad(m, 1)[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]]
    grown = np.any([shifted(left, *d) for d in cross], axis=0)
    mended = np.all([shifted(np.pad(grown, 1, constant_values=True), *d)[1:-1, 1:-1] for d in cross], axis=0)
    return np.where(left | (mended & rules), 0, 255)


def evened(px: np.ndarray, size: int = 7) -> np.ndarray:
    """Divided by its background, the brightest pixel around each, and scaled to 255; where that is black, white."""
    ground = spread(px, size, np.max).astype("f8")
    return whole(np.where(ground > 0, px / np.where(ground > 0, ground, 1) * 255, 255))


def mask_levels(px: np.ndarray, *, high: int = 4, wide: int = 16, above: int = 240, level: int = 40) -> np.ndarray:
    """A label image: level where bright pixels, spread over a rectangle, are above the limit, else 0."""
    for axis, size in ((0, high), (1, wide)):
        r = size // 2
        padded = np.pad(px, [(r, size - 1 - r) if a == axis else (0, 0) for a in (0, 1)], constant_values=0)
        px = np.max([np.take(padded, range(i, i + px.shape[axis]), axis) for i in range(size)], axis=0)
    return np.where(px > above, level, 0)


def text_region(px: np.ndarray, scores: np.ndarray, *, pad: int = 10, least_area: int = 100, kernel: int = 5) -> tuple[int, int, int, int] | None:
    """x1, y1, x2, y2 (ends excluded) around all large parts of a mask of scores from 0 to 1, padded; None without any.

    The mask may have any size; it's brought to the page's, cut at Otsu's threshold, closed and opened.
    """
    mask = np.floor(resized(scores, *px.shape) * 255).astype(int)
    ink = np.where(mask > otsu(mask), 255, 0) if mask.min() < mask.max() else np.zeros(mask.shape, dtype=int)
    m = measured(px, labelled(opened(closed(ink, kernel), kernel) > 0))
    large = m["area"] > least_area
    if not large.any():
        return None
    h, w = px.shape
    return max(0, int(m["x1"][large].min()) - pad), max(0, int(m["y1"][large].min()) - pad), min(w, int(m["x2"][large].max()) + 1 + pad), min(h, int(m["y2"][large].max()) + 1 + pad)


def noisy(px: np.ndarray, seed: int, sigma: float = 25.0) -> np.ndarray:
    """Darkened by the negative half of Gaussian noise; the same seed gives the same noise."""
    return whole(px + np.minimum(np.random.default_rng(seed).normal(0, sigma, px.shape), 0))


def fitted(px: np.ndarray, *, aspect: float = 4.0, h: int = 40, w: int = 200, fill: int = 255) -> np.ndarray:
    """Filled up below or at the right until it's ``aspect`` times as wide as high, then resized."""
    high, wide = px.shape
    if wide < aspect * high:
        px = np.pad(px, ((0, 0), (0, int(np.ceil(aspect * high)) - wide)), constant_values=fill)
    elif wide > aspect * high:
        px = np.pad(px, ((0, int(np.ceil(wide / aspect)) - high), (0, 0)), constant_values=fill)
    return whole(resized(px, h, w))


def narrowed(px: np.ndarray, most: int = 1024) -> np.ndarray:
    """At most so many pixels wide, the shape kept."""
    h, w = px.shape
    return px if w <= most else whole(resized(px, max(1, round(h * most / w)), most))


def chained(pages: DataFrame, key: str, steps: list[Step]) -> DataFrame:
    """key, h, w, px after all steps, in order. Null rasters stay null; empty ones are left as they are."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ws, out = [], [], []
            for w, px in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not px.is_valid or not len(px):
                    hs, ws, out = [*hs, 0 if px.is_valid else None], [*ws, w], [*out, px.as_py()]
                    continue
                p = px.values.to_numpy(zero_copy_only=False).reshape(-1, w)
                for step in steps:
                    p = step(p)
                hs, ws, out = [*hs, p.shape[0]], [*ws, p.shape[1]], [*out, p.reshape(-1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hs, pa.int32()), pa.array(ws, pa.int32()), pa.array(out, pa.list_(pa.int32()))], [key, "h", "w", "px"])

    return pages.select(key, F.col("w").cast("int"), "px").mapInArrow(run, f"{key} {kind}, h int, w int, px array<int>")


def halved(pages: DataFrame, key: str) -> DataFrame:
    """key, side, w, px: pages that are wider than high as two, by column arithmetic; the others whole."""
    h = (F.size("px") / F.col("w")).cast("int")
    half = F.floor(F.col("w") / 2).cast("int")
    part = lambda side, x, w: F.struct(F.lit(side).alias("side"), x.alias("x_"), w.alias("v_"))
    parts = F.when(F.col("w") > h, F.array(part("left", F.lit(0), half), part("right", half, F.col("w") - half))).otherwise(F.array(part("whole", F.lit(0), F.col("w"))))
    rows = pages.select(key, "px", F.col("w").alias("of_"), h.alias("h_"), F.inline(parts))
    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.col("h_") - 1), lambda y: F.slice("px", y * F.col("of_") + F.col("x_") + 1, F.col("v_"))))
    return rows.withColumn("px", F.when(F.col("side") == "whole", F.col("px")).otherwise(cut)).select(key, "side", F.col("v_").alias("w"), "px")


def cropped(pages: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """boxes (key, x1, y1, x2, y2, any more) with h, w, px of the page within them; clamped to the page, empty ones go."""
    h = (F.size("px") / F.col("w_")).cast("int")
    own = boxes.join(pages.select(key, F.col("w").alias("w_"), "px"), key)
    # one step a column: a column that is named again within one select would be taken for the new one in a lambda
    own = own.withColumn("x1", F.greatest("x1", F.lit(0))).withColumn("y1", F.greatest("y1", F.lit(0))).withColumn("x2", F.least("x2", "w_")).withColumn("y2", F.least("y2", h))
    own = own.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    cut = F.flatten(F.transform(F.sequence(F.col("y1").cast("int"), F.col("y2").cast("int") - 1), lambda y: F.slice("px", y * F.col("w_") + F.col("x1").cast("int") + 1, (F.col("x2") - F.col("x1")).cast("int"))))
    return own.withColumn("px", cut).withColumn("h", (F.col("y2") - F.col("y1")).cast("int")).withColumn("w", (F.col("x2") - F.col("x1")).cast("int")).drop("w_")


def prepared(pages: DataFrame, key: str, *, borders: bool = False, sharpen: float = 2.0, skew_options: dict | None = None, clean_options: dict | None = None, border_options: dict | None = None) -> DataFrame:
    """Rendered pages (key, w, px), in the order of key, to single clean pages: number, key, side, h, w, px.

    Sharpened, halved if wider than high, turned upright, cleaned, long lines painted over if wanted; numbered from 0
    over all pages by a position that doesn't gather them.
    """
    from ..functions.ranges import numbered

    sides = halved(chained(pages, key, [partial(sharpened, factor=sharpen)]).drop("h"), key).withColumn("page_", F.struct(key, "side"))
    steps: list[Step] = [partial(deskewed, **(skew_options or {})), partial(clean, **(clean_options or {}))]
    if borders:
        steps.append(partial(without_borders, **(border_options or {})))
    done = chained(sides, "page_", steps).select(F.col(f"page_.{key}").alias(key), "page_.side", "h", "w", "px")
    places = numbered(sides.select(key, "side"), [key, "side"]).select(key, "side", F.col("i_").alias("number"))
    return places.join(done, [key, "side"])


def finished(pages: DataFrame, key: str, *, amount: float = 1.5, **options) -> DataFrame:
    """Turned upright and sharpened by an unsharp mask."""
    return chained(pages, key, [partial(deskewed, **options), partial(unsharp, amount=amount)])
