"""Boxes and polygons as columns; page-wise orders and merges as folds over sorted arrays.

Boxes are structs of x1, y1, x2, y2. Folds take an array of boxes of one page, already sorted where an order matters;
every order ends in an ordinal, so ties are stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def coordinates(poly: Column, odd: bool) -> Column:
    """Of a flat array x1, y1, x2, y2, ...: the x, or the y."""
    return F.filter(poly, lambda _, i: i % 2 == int(odd))


def bounding_box(poly: Column) -> Column:
    """x, y, w, h of the pixels that integer corners span, both ends included."""
    xs, ys = coordinates(poly, False), coordinates(poly, True)
    return F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs) + 1).alias("w"), (F.array_max(ys) - F.array_min(ys) + 1).alias("h")
    )


def quad_box(c: Column) -> Column:
    """The rectangle of a quad of eight numbers, by its lower left and upper right corners."""
    return box(F.get(c, F.lit(6)), F.get(c, F.lit(3)), F.get(c, F.lit(4)), F.get(c, F.lit(7)))


def padded_x(x: Column, w: Column, pad: int, width: Column) -> tuple[Column, Column]:
    """x and w after padding on both sides, within the image."""
    left = F.greatest(x - pad, F.lit(0))
    return left, F.least(w + 2 * pad, width - left)


def rescaled(poly: Column, fx: Column, fy: Column, factor: float = 2.0) -> Column:
    return F.transform(poly, lambda v, i: v * F.when(i % 2 == 0, fx).otherwise(fy) * factor)


def split_tall(y1: Column, y2: Column, median_height: Column, tolerance: float) -> Column:
    """Top and bottom of the pieces of a box: as many as it's medians high, rounded half to even; the last takes the rest."""
    h = y2 - y1
    ratio = h / median_height
    n = F.when(ratio > 1 + tolerance, F.bround(ratio).cast("int")).otherwise(F.lit(1))
    step = F.floor(h / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((y1 + i * step).alias("y1"), F.when(i == n - 1, y2).otherwise(y1 + (i + 1) * step).alias("y2")))


def _fold(boxes: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(boxes, start, step)


def line_anchors(tops: Column, tolerance: int = 10) -> Column:
    """For tops in ascending order, the line of each, from 0: a new one begins more than the tolerance below the line's first."""
    start = F.struct(F.lit(None).cast("long").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(s: Column, y: Column) -> Column:
        new = s["anchor"].isNull() | (y - s["anchor"] > tolerance)
        line = s["line"] + new.cast("int")
        return F.struct(F.when(new, y.cast("long")).otherwise(s["anchor"]).alias("anchor"), line.alias("line"), F.concat(s["lines"], F.array(line)).alias("lines"))

    return _fold(tops, start, step)["lines"]


def suppressed(boxes: Column, share: float = 0.9, kind: str = "struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>") -> Column:
    """Boxes left after overlaps: one that shares more than so much of the smaller area with a kept box replaces it if larger, else goes."""

    def area(b: Column) -> Column:
        return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])

    def overlaps(a: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
        h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        return w * h > F.lit(share) * F.least(area(a), area(b))

    def step(kept: Column, b: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: overlaps(k, b)), True).cast("int")
        return F.when(hit == 0, F.concat(kept, F.array(b))).otherwise(
            F.transform(kept, lambda k, i: F.when((i == hit - 1) & (area(b) > area(k)), b).otherwise(k))
        )

    return _fold(boxes, F.array().cast(f"array<{kind}>"), step)


def merged_lines(boxes: Column, tolerance: float | Callable[[Column], Column] = 15, kind: str = "struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>") -> Column:
    """Boxes in order of their middles merged into lines: a box joins the current line if its middle is within the tolerance of the line's; the tolerance may be a function of the box's middle."""
    allowed = tolerance if callable(tolerance) else lambda _: F.lit(tolerance)
    middle = lambda b: (b["y1"] + b["y2"]) / 2
    start = F.array().cast(f"array<{kind}>")

    def step(lines: Column, b: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        joins = F.coalesce(F.abs(middle(b) - middle(last)) <= allowed(middle(b)), F.lit(False))
        union = box(F.least(last["x1"], b["x1"]), F.least(last["y1"], b["y1"]), F.greatest(last["x2"], b["x2"]), F.greatest(last["y2"], b["y2"]))
        return F.when(joins, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(union))).otherwise(F.concat(lines, F.array(b)))

    return _fold(boxes, start, step)


def canvas_after_rotation(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height that hold an image rotated about its centre."""
    s, c = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    return F.floor(h * s + w * c + 0.5).cast("int"), F.floor(h * c + w * s + 0.5).cast("int")


def warped(x: Column, y: Column, m: list[list[float]]) -> tuple[Column, Column]:
    """A point through a 3 by 3 projective map."""
    rows = [F.lit(float(a)) * x + F.lit(float(b)) * y + F.lit(float(c)) for a, b, c in m]
    return rows[0] / rows[2], rows[1] / rows[2]
