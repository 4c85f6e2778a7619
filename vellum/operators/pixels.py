"""Pixel tables of small rasters: (id, x, y, v). Whole scans go through kernels instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded(rasters: DataFrame, key: str, width: int) -> DataFrame:
    p = rasters.select(key, F.posexplode("px").alias("i", "v"))
    return p.select(key, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "v")


def box_filter(pixels: DataFrame, key: str, radius: int, statistic) -> DataFrame:
    """A statistic that separates (minimum, maximum, sum), over rows and then over columns of the square around each pixel."""
    row = Window.partitionBy(key, "y").orderBy("x").rangeBetween(-radius, radius)
    column = Window.partitionBy(key, "x").orderBy("y").rangeBetween(-radius, radius)
    return pixels.withColumn("v", statistic("v").over(row)).withColumn("v", statistic("v").over(column))


def sharpened(pixels: DataFrame, key: str) -> DataFrame:
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    v = F.col("v")
    sides = pixels
    for name, f, w in (("l_", F.lag, row), ("r_", F.lead, row), ("u_", F.lag, column), ("d_", F.lead, column)):
        sides = sides.withColumn(name, F.coalesce(f("v").over(w), v))
    out = F.least(F.greatest(5 * v - F.col("l_") - F.col("r_") - F.col("u_") - F.col("d_"), F.lit(0)), F.lit(255))
    return sides.select(key, "x", "y", out.cast("int").alias("v"))


def adaptive(pixels: DataFrame, key: str, radius: int, offset: int) -> DataFrame:
    """255 where a pixel is darker than the mean around it by the offset or more, else 0."""
    ones = pixels.withColumn("n_", F.lit(1))
    row = Window.partitionBy(key, "y").orderBy("x").rangeBetween(-radius, radius)
    column = Window.partitionBy(key, "x").orderBy("y").rangeBetween(-radius, radius)
    sums = ones.withColumn("s_", F.sum("v").over(row)).withColumn("n_", F.sum("n_").over(row))
    sums = sums.withColumn("s_", F.sum("s_").over(column)).withColumn("n_", F.sum("n_").over(column))
    return sums.select(key, "x", "y", F.when(F.col("v") <= F.col("s_") / F.col("n_") - offset, 255).otherwise(0).alias("v"))


def bands(profile: DataFrame, key: str, row: str, ink: str) -> DataFrame:
    """Runs of rows whose ink is below the middle of the page's range: first_row, last_row."""
    w = Window.partitionBy(key)
    middle = (F.max(ink).over(w) - F.min(ink).over(w)) / 2 + F.min(ink).over(w)
    low = profile.withColumn("m_", middle).where(F.col(ink) < F.col("m_"))
    island = F.col(row) - F.row_number().over(Window.partitionBy(key).orderBy(row))
    return low.withColumn("i_", island).groupBy(key, "i_").agg(F.min(row).alias("first_row"), F.max(row).alias("last_row")).drop("i_")
