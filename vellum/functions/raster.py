"""Small rasters as columns: row-major arrays of 0 to 255 with a width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import bound

#: Weights of red, green, blue.
LUMA = (0.299, 0.587, 0.114)
LUMA_LINEAR = (0.2125, 0.7154, 0.0721)


def gray(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = LUMA) -> Column:
    return weights[0] * r + weights[1] * g + weights[2] * b


def clipped(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def binary(px: Column, threshold: Column | int, *, inverted: bool = False) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    on, off = (0, 255) if inverted else (255, 0)
    return F.transform(px, lambda x: F.when(x > t, on).otherwise(off))


def row_sums(px: Column, width: int) -> Column:
    """The horizontal projection profile."""
    rows = F.sequence(F.lit(0), F.floor(F.size(px) / width).cast("int") - 1)
    return F.transform(rows, lambda r: F.aggregate(F.slice(px, r * width + 1, width), F.lit(0).cast("long"), lambda s, x: s + x))


def otsu(px: Column) -> Column:
    """The threshold with the greatest variance between the classes up to it and above it; the smallest of equal ones.

    One pass over the sorted values: where a value ends, the count and the sum so far give the variance, in whole
    numbers up to a division.
    """

    def best(values: Column) -> Column:
        n, sums = F.size(values), F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)

        def scan(total: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("m"), F.lit(0.0).alias("v"), F.get(values, F.lit(0)).alias("t"))

            def step(s: Column, i: Column) -> Column:
                x, w = F.get(values, i), i + 1
                m = s["m"] + x
                d = m * n - total * w
                v = F.when(F.get(values, w) != x, d * d / (w.cast("double") * (n - w)))
                return F.struct(m.alias("m"), F.greatest(s["v"], v).alias("v"), F.when(v > s["v"], x).otherwise(s["t"]).alias("t"))

            return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), start, step)["t"]

        return bound(sums, scan)

    return bound(F.sort_array(px), best)


def min_max(px: Column) -> Column:
    low, high = F.array_min(px), F.array_max(px)
    return F.transform(px, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0)))


def normalised(x: Column, mean: float, deviation: float) -> Column:
    return (x - F.lit(mean * 255)) / F.lit(deviation * 255)


def padding_to_aspect(w: Column, h: Column, aspect: float = 4.0) -> tuple[Column, Column]:
    """Columns and rows of white to add so that w / h is the aspect."""
    return F.greatest(F.floor(h * aspect).cast("int") - w, F.lit(0)), F.greatest(F.floor(w / aspect).cast("int") - h, F.lit(0))


def fitted(w: Column, h: Column, to_w: int, to_h: int) -> tuple[Column, Column, Column, Column]:
    """Size after scaling into to_w by to_h with the aspect kept, and the left and top margins that centre it."""
    scale = F.least(F.lit(to_w) / w, F.lit(to_h) / h)
    nw, nh = (F.greatest(F.lit(1), F.floor(x * scale).cast("int")) for x in (w, h))
    return nw, nh, F.floor((to_w - nw) / 2).cast("int"), F.floor((to_h - nh) / 2).cast("int")


def canvas(w: Column, h: Column, most: int, grid: int = 32) -> tuple[Column, Column, Column]:
    """The ratio that keeps the longer side within ``most``, and the size filled up to the grid."""
    ratio = F.least(F.lit(1.0), most / F.greatest(w, h))
    up = lambda x: (F.ceil(F.floor(x * ratio) / grid) * grid).cast("int")
    return ratio, up(w), up(h)


def heat_levels(scores: Column) -> Column:
    """Scores cut to 0 to 1, as whole levels from 0 to 255: what a colour map takes."""
    return F.transform(scores, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
