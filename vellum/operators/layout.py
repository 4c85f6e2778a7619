"""Detected boxes to lines in reading order, page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

_BOX = ("x1", "y1", "x2", "y2")


def reading_order(boxes: DataFrame, page: str = "page_id", tolerance: int = 10) -> DataFrame:
    """boxes with line and place (both from 0): lines by the fold over tops, places within a line by x1.

    A page's boxes meet in one array, some hundred at most; pages are what is distributed.
    """
    folded = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("y1", "ord", "x1", "x2", "y2"))).alias("b_"))
    folded = folded.withColumn("l_", G.line_anchors(F.transform("b_", lambda b: b["y1"]), tolerance))
    rows = folded.select(page, F.inline(F.arrays_zip(F.col("b_").alias("b"), F.col("l_").alias("line")))).select(page, "b.*", "line")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(page, "line").orderBy("x1", "y1", "ord")) - 1)


def filtered(polygons: DataFrame, *, page: str = "page_id", pad: int = 20, min_width: int = 0, top: int = 0, bottom: int = 1 << 30, width: int = 1 << 30, most_off: int = 800) -> DataFrame:
    """Polygons (a column poly) to padded boxes: narrow ones and those in the margins go, then those far from the page's median centre."""
    r = polygons.withColumn("r_", G.bounding_box(F.col("poly")))
    r = r.where((F.col("r_.w") > min_width) & (F.col("r_.y") > top) & (F.col("r_.y") + F.col("r_.h") < bottom))
    x, w = G.padded_x(F.col("r_.x"), F.col("r_.w"), pad, F.lit(width))
    r = r.select(page, "ord", x.alias("x1"), F.col("r_.y").alias("y1"), (x + w).alias("x2"), (F.col("r_.y") + F.col("r_.h")).alias("y2"))
    centre = (F.col("x1") + F.col("x2")) / 2
    # the window comes after the filter: its median depends on it
    return r.withColumn("c_", F.median(centre).over(Window.partitionBy(page))).where(F.abs(centre - F.col("c_")) < most_off).drop("c_")


def split_tall(boxes: DataFrame, page: str = "page_id", tolerance: float = 0.6) -> DataFrame:
    """Boxes much higher than their page's median height cut into as many pieces as they're medians high; piece numbers them."""
    h = F.median(F.col("y2") - F.col("y1")).over(Window.partitionBy(page))
    pieces = boxes.withColumn("h_", h).withColumn("p_", G.split_tall(F.col("y1"), F.col("y2"), F.col("h_"), tolerance))
    keep = [c for c in pieces.columns if c not in ("y1", "y2", "h_", "p_")]
    return pieces.select(*keep, F.posexplode("p_").alias("piece", "q_")).select(*keep, "piece", F.col("q_.y1").alias("y1"), F.col("q_.y2").alias("y2"))


def snapped(boxes: DataFrame, page: str = "page_id", left: int = 30, right: int = 20) -> DataFrame:
    """All boxes of a page get its median edges, moved outwards."""
    w = Window.partitionBy(page)
    return boxes.withColumn("a_", F.median("x1").over(w).cast("int") - left).withColumn("x2", F.median("x2").over(w).cast("int") + right).withColumn("x1", F.col("a_")).drop("a_")


def suppressed(boxes: DataFrame, page: str = "page_id", share: float = 0.9) -> DataFrame:
    """Boxes left after overlaps, in order of ord."""
    own = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("ord", *[F.col(c).cast("long").alias(c) for c in _BOX]))).alias("b_"))
    plain = F.transform("b_", lambda b: F.struct(*[b[c].alias(c) for c in _BOX]))
    return own.select(page, F.posexplode(G.suppressed(plain, share)).alias("place", "q_")).select(page, "place", "q_.*")


def merged_lines(boxes: DataFrame, page: str = "page_id", tolerance: float = 15, pad: int = 140) -> DataFrame:
    """Boxes merged into lines by their middles; pages of more than one box are padded sideways."""
    own = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct((F.col("y1") + F.col("y2")).alias("m"), "ord", *[F.col(c).cast("long").alias(c) for c in _BOX]))).alias("b_"))
    plain = F.transform("b_", lambda b: F.struct(*[b[c].alias(c) for c in _BOX]))
    p = F.when(F.size("b_") > 1, pad).otherwise(0)
    rows = own.select(page, p.alias("p_"), F.posexplode(G.merged_lines(plain, tolerance)).alias("line", "q_"))
    return rows.select(page, "line", F.greatest(F.col("q_.x1") - F.col("p_"), F.lit(0)).alias("x1"), "q_.y1", (F.col("q_.x2") + F.col("p_")).alias("x2"), "q_.y2")


def full_width_lines(boxes: DataFrame, page: str = "page_id", *, width: int = 500, height: int = 1200, upper: float = 15, lower: float = 10) -> DataFrame:
    """Boxes merged into lines with a tolerance for the upper half of the page and one for the lower; lines span the page, but a page's only box stays as it is."""
    own = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct((F.col("y1") + F.col("y2")).alias("m"), "ord", *[F.col(c).cast("long").alias(c) for c in _BOX]))).alias("b_"))
    plain = F.transform("b_", lambda b: F.struct(*[b[c].alias(c) for c in _BOX]))
    tolerance = lambda y: F.when(y < height / 2, F.lit(upper)).otherwise(F.lit(lower))
    rows = own.select(page, (F.size("b_") > 1).alias("many_"), F.posexplode(G.merged_lines(plain, tolerance)).alias("line", "q_"))
    return rows.select(page, "line", F.when(F.col("many_"), 0).otherwise(F.col("q_.x1")).alias("x1"), "q_.y1", F.when(F.col("many_"), width - 1).otherwise(F.col("q_.x2")).alias("x2"), "q_.y2")


def scaled_regions(boxes: DataFrame, *, side: int = 512, pad: int = 10) -> DataFrame:
    """Boxes found on a square of ``side`` pixels, back in their image (columns width, height): scaled, cut to whole pixels, padded, clamped."""
    at = lambda c, size: (F.col(c) * F.col(size) / side).cast("int")
    keep = [c for c in boxes.columns if c not in _BOX]
    return boxes.select(
        *keep, F.greatest(at("x1", "width") - pad, F.lit(0)).alias("x1"), F.greatest(at("y1", "height") - pad, F.lit(0)).alias("y1"), F.least(at("x2", "width") + pad, F.col("width")).alias("x2"), F.least(at("y2", "height") + pad, F.col("height")).alias("y2"),
    )


def of_level(boxes: DataFrame, level: int = 5) -> DataFrame:
    """Boxes of an OCR engine's level: 5 is words."""
    return boxes.where(F.col("level") == level)


def union_boxes(boxes: DataFrame, page: str = "page_id", pad: int = 10, width: int = 1 << 30, height: int = 1 << 30) -> DataFrame:
    """The box around a page's boxes, padded, within the page."""
    u = boxes.groupBy(page).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return u.select(page, F.greatest(F.col("x1") - pad, F.lit(0)).alias("x1"), F.greatest(F.col("y1") - pad, F.lit(0)).alias("y1"), F.least(F.col("x2") + pad, F.lit(width)).alias("x2"), F.least(F.col("y2") + pad, F.lit(height)).alias("y2"))


def line_boxes(polygons: DataFrame, *, page: str = "page_id", tolerance: float = 0.6, share: float = 0.9, **options) -> DataFrame:
    """From polygons to text lines, top to bottom: filter, split tall ones, snap, suppress overlaps, number."""
    pieces = split_tall(filtered(polygons, page=page, **options), page, tolerance)
    pieces = pieces.withColumn("ord", F.row_number().over(Window.partitionBy(page).orderBy(F.col("piece") > 0, "ord", "piece")))
    kept = suppressed(snapped(pieces.drop("piece"), page), page, share)
    return kept.withColumn("line_no", F.row_number().over(Window.partitionBy(page).orderBy("y1", "place"))).drop("place")


def split_pages(pages: DataFrame, *, by: str = "width", narrow: int = 350, wide: int = 450, strict: bool = False) -> DataFrame:
    """Page images to single pages: side, x, w.

    By width: narrow ones stay, wide ones are halved, those between stay, or are lost if strict. By aspect: those wider
    than high are halved.
    """
    w = F.col("width")
    whole = F.struct(F.lit("whole").alias("side"), F.lit(0).alias("x"), w.alias("w"))
    half = F.floor(w / 2).cast("int")
    halves = F.array(F.struct(F.lit("left").alias("side"), F.lit(0).alias("x"), half.alias("w")), F.struct(F.lit("right").alias("side"), half.alias("x"), (w - half).alias("w")))
    nothing = F.slice(halves, 1, 0)
    if by == "aspect":
        parts = F.when(w > F.col("height"), halves).otherwise(F.array(whole))
    else:
        parts = F.when(w < narrow, F.array(whole)).when(w > wide, halves).otherwise(nothing if strict else F.array(whole))
    return pages.select("*", F.inline(parts))
