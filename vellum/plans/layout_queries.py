"""Polygons, boxes, reading order, page splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout
from .registry import query
from .standins import SQL_BOXES, boxes, read


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted quadrilaterals around the boxes."""
    b = boxes(spark, sf_dir)
    slant = F.col("x1") % 5
    corners = [F.col("x1"), F.col("y1") + slant, F.col("x2"), F.col("y1"), F.col("x2") - slant, F.col("y2"), F.col("x1"), F.col("y2") - slant]
    return b.select("page_id", "ord", F.array(*corners).alias("poly"))


@query(f"SELECT page_id, ord::INT AS ord, x1 AS x, y1 AS y, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h FROM {SQL_BOXES}")
def poly_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("page_id", "ord", G.bounding_box(F.col("poly")).alias("r")).select("page_id", "ord", "r.*")


@query(f"SELECT page_id, ord::INT AS ord, x1, y2 - x1 % 5 AS y2_, x2 - x1 % 5 AS x2_, y1 AS y1 FROM {SQL_BOXES}".replace("x1, y2 - x1 % 5 AS y2_, x2 - x1 % 5 AS x2_, y1 AS y1", "x1, y1, x2 - x1 % 5 AS x2, y2 - x1 % 5 AS y2"))
def quad_to_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("page_id", "ord", G.quad_box(F.col("poly")).alias("r")).select("page_id", "ord", "r.*")


@query(f"SELECT page_id, ord::INT AS ord, greatest(x1 - 20, 0) AS x, least(x2 - x1 + 40, 800 - greatest(x1 - 20, 0)) AS w FROM {SQL_BOXES}")
def pad_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = G.padded_x(F.col("x1"), F.col("x2") - F.col("x1"), 20, F.lit(800))
    return boxes(spark, sf_dir).select("page_id", "ord", x.alias("x"), w.alias("w"))


_FILTERED = f"""(SELECT page_id, ord, x1, y1, x1 + w AS x2, y2 FROM (SELECT *, median(x1 + w / 2) OVER (PARTITION BY page_id) AS c FROM (
  SELECT page_id, ord, greatest(x1 - 20, 0) AS x1, y1, least(x2 - x1 + 41, 900 - greatest(x1 - 20, 0)) AS w, y2 + 1 AS y2 FROM {SQL_BOXES} WHERE x2 - x1 + 1 > 40 AND y1 > 15 AND y2 + 1 < 880)) WHERE abs(x1 + w / 2 - c) < 200)"""
_FILTER = {"pad": 20, "min_width": 40, "top": 15, "bottom": 880, "width": 900, "most_off": 200}


@query(f"SELECT page_id, ord::INT AS ord, x1, y1, x2, y2 FROM {_FILTERED}")
def contour_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.filtered(polygons(spark, sf_dir), **_FILTER)


@query(f"""WITH m AS (SELECT *, median(y2 - y1) OVER (PARTITION BY page_id) AS mh FROM {SQL_BOXES}),
n AS (SELECT *, CASE WHEN (y2 - y1) / mh > 1.6 THEN round_even((y2 - y1) / mh, 0)::INT ELSE 1 END AS n FROM m), p AS (SELECT *, unnest(range(n)) AS piece FROM n)
SELECT page_id, ord::INT AS ord, piece::INT AS piece, x1, x2, y1 + piece * ((y2 - y1) // n) AS y1, CASE WHEN piece = n - 1 THEN y2 ELSE y1 + (piece + 1) * ((y2 - y1) // n) END AS y2 FROM p""")
def tall_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.split_tall(boxes(spark, sf_dir)).select("page_id", "ord", "piece", "x1", "x2", "y1", "y2")


@query(f"SELECT page_id, ord::INT AS ord, trunc(median(x1) OVER p)::INT - 30 AS x1, y1, trunc(median(x2) OVER p)::INT + 20 AS x2, y2 FROM {SQL_BOXES} WINDOW p AS (PARTITION BY page_id)")
def snap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.snapped(boxes(spark, sf_dir)).select("page_id", "ord", "x1", "y1", "x2", "y2")


@query(f"SELECT page_id, greatest(min(x1) - 10, 0) AS x1, greatest(min(y1) - 10, 0) AS y1, least(max(x2) + 10, 900) AS x2, least(max(y2) + 10, 900) AS y2 FROM {SQL_BOXES} GROUP BY page_id")
def union_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.union_boxes(boxes(spark, sf_dir), width=900, height=900)


@query(f"SELECT page_id, ord::INT AS ord, x1 * 0.5::DOUBLE * 2.0::DOUBLE AS x, (y1 + x1 % 5) * 0.25::DOUBLE * 2.0::DOUBLE AS y FROM {SQL_BOXES}")
def box_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.rescaled(F.col("poly"), F.lit(0.5), F.lit(0.25))
    return polygons(spark, sf_dir).select("page_id", "ord", F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, ord) AS k FROM {SQL_BOXES}),
f AS (SELECT page_id, ord, x1, y1, k, y1 AS anchor, 0 AS line FROM b WHERE k = 1 UNION ALL
  SELECT b.page_id, b.ord, b.x1, b.y1, b.k, CASE WHEN b.y1 - f.anchor > 10 THEN b.y1 ELSE f.anchor END, f.line + (b.y1 - f.anchor > 10)::INT FROM f JOIN b ON b.page_id = f.page_id AND b.k = f.k + 1)
SELECT page_id, ord::INT AS ord, line::INT AS line, (row_number() OVER (PARTITION BY page_id, line ORDER BY x1, y1, ord) - 1)::INT AS place FROM f""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(boxes(spark, sf_dir)).select("page_id", "ord", "line", "place")


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1 + y2, ord) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM {SQL_BOXES}),
f AS (SELECT page_id, k, n, 0 AS line, x1, y1, x2, y2 FROM b WHERE k = 1 UNION ALL
  SELECT page_id, k, n, line + (NOT j)::INT, CASE WHEN j THEN least(x1, a1) ELSE a1 END, CASE WHEN j THEN least(y1, b1) ELSE b1 END, CASE WHEN j THEN greatest(x2, a2) ELSE a2 END, CASE WHEN j THEN greatest(y2, b2) ELSE b2 END
  FROM (SELECT f.page_id, b.k, f.n, f.line, f.x1, f.y1, f.x2, f.y2, b.x1 AS a1, b.y1 AS b1, b.x2 AS a2, b.y2 AS b2, abs((b.y1 + b.y2) / 2 - (f.y1 + f.y2) / 2) <= 15 AS j FROM f JOIN b ON b.page_id = f.page_id AND b.k = f.k + 1))
SELECT page_id, line::INT AS line, greatest(arg_max(x1, k) - CASE WHEN n > 1 THEN 140 ELSE 0 END, 0) AS x1, arg_max(y1, k) AS y1, arg_max(x2, k) + CASE WHEN n > 1 THEN 140 ELSE 0 END AS x2, arg_max(y2, k) AS y2 FROM f GROUP BY page_id, line, n""")
def merge_boxes_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merged_lines(boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1 + y2, ord) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM {SQL_BOXES}),
f AS (SELECT page_id, k, n, 0 AS line, x1, y1, x2, y2 FROM b WHERE k = 1 UNION ALL
  SELECT page_id, k, n, line + (NOT j)::INT, CASE WHEN j THEN least(x1, a1) ELSE a1 END, CASE WHEN j THEN least(y1, b1) ELSE b1 END, CASE WHEN j THEN greatest(x2, a2) ELSE a2 END, CASE WHEN j THEN greatest(y2, b2) ELSE b2 END
  FROM (SELECT f.page_id, b.k, f.n, f.line, f.x1, f.y1, f.x2, f.y2, b.x1 AS a1, b.y1 AS b1, b.x2 AS a2, b.y2 AS b2,
    abs((b.y1 + b.y2) / 2 - (f.y1 + f.y2) / 2) <= CASE WHEN (b.y1 + b.y2) / 2 < 450 THEN 15 ELSE 10 END AS j FROM f JOIN b ON b.page_id = f.page_id AND b.k = f.k + 1))
SELECT page_id, line::INT AS line, CASE WHEN n > 1 THEN 0 ELSE arg_max(x1, k) END AS x1, arg_max(y1, k) AS y1, CASE WHEN n > 1 THEN 799 ELSE arg_max(x2, k) END AS x2, arg_max(y2, k) AS y2 FROM f GROUP BY page_id, line, n""")
def full_width_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerances of 15 and 10 by the half of the page; lines from edge to edge."""
    return layout.full_width_lines(boxes(spark, sf_dir), width=800, height=900)


_WARP = [[1.1, 0.2, 3.0], [-0.1, 0.9, 7.0], [0.0001, 0.0002, 1.0]]


@query(f"SELECT page_id, ord::INT AS ord, round((1.1::DOUBLE * x1 + 0.2::DOUBLE * y1 + 3) / (0.0001::DOUBLE * x1 + 0.0002::DOUBLE * y1 + 1), 9) AS x, round((-0.1::DOUBLE * x1 + 0.9::DOUBLE * y1 + 7) / (0.0001::DOUBLE * x1 + 0.0002::DOUBLE * y1 + 1), 9) AS y FROM {SQL_BOXES}")
def point_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = G.warped(F.col("x1"), F.col("y1"), _WARP)
    return boxes(spark, sf_dir).select("page_id", "ord", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query(f"""SELECT page_id, ord::INT AS ord, greatest(trunc(x1 * 1000 / 512)::INT - 10, 0) AS x1, greatest(trunc(y1 * 700 / 512)::INT - 10, 0) AS y1, least(trunc(x2 * 1000 / 512)::INT + 10, 1000) AS x2, least(trunc(y2 * 700 / 512)::INT + 10, 700) AS y2 FROM {SQL_BOXES}""")
def scaled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = boxes(spark, sf_dir).select("page_id", "ord", "x1", "y1", "x2", "y2", F.lit(1000).alias("width"), F.lit(700).alias("height"))
    return layout.scaled_regions(own).select("page_id", "ord", "x1", "y1", "x2", "y2")


@query(f"SELECT page_id, ord::INT AS ord, x1, y1 FROM {SQL_BOXES} WHERE x1 % 6 = 5")
def word_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.of_level(boxes(spark, sf_dir).withColumn("level", F.col("x1") % 6)).select("page_id", "ord", "x1", "y1")


@query()
def overlap_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.suppressed(boxes(spark, sf_dir))


@query()
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from polygons to numbered lines."""
    return layout.line_boxes(polygons(spark, sf_dir), **_FILTER)


@query(f"""SELECT a.page_id, count(*) AS pairs FROM {SQL_BOXES} a JOIN {SQL_BOXES} b ON a.page_id = b.page_id AND a.ord < b.ord
  AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0.9::DOUBLE * least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) GROUP BY a.page_id""")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of a page's boxes overlap; a page has some hundred boxes at most."""
    b = boxes(spark, sf_dir)
    a = b.select(*[F.col(c).alias(f"{c}_a") if c != "page_id" else F.col(c) for c in b.columns])
    w = F.greatest(F.lit(0), F.least("x2", "x2_a") - F.greatest("x1", "x1_a"))
    h = F.greatest(F.lit(0), F.least("y2", "y2_a") - F.greatest("y1", "y1_a"))
    least = F.least((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), (F.col("x2_a") - F.col("x1_a")) * (F.col("y2_a") - F.col("y1_a")))
    return a.join(b, "page_id").where((F.col("ord_a") < F.col("ord")) & (w * h > F.lit(0.9) * least)).groupBy("page_id").agg(F.count(F.lit(1)).alias("pairs"))


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_size") * 12 + (F.col("p_partkey") % 9).cast("int")).alias("width"), (300 + F.col("p_partkey") % 200).cast("int").alias("height"))


_DIMS = "(SELECT p_partkey AS page_id, p_size * 12 + (p_partkey % 9)::INT AS width, (300 + p_partkey % 200)::INT AS height FROM part)"
_PARTS = "SELECT page_id, 'whole' AS side, 0 AS x, width AS w FROM {0} WHERE {1} UNION ALL SELECT page_id, 'left', 0, width // 2 FROM {0} WHERE {2} UNION ALL SELECT page_id, 'right', width // 2, width - width // 2 FROM {0} WHERE {2}"


@query(_PARTS.format(_DIMS, "width < 350", "width > 450"))
def page_split_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.split_pages(_dims(spark, sf_dir), strict=True).select("page_id", "side", "x", "w")


@query(_PARTS.format(_DIMS, "width <= height", "width > height"))
def page_split_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.split_pages(_dims(spark, sf_dir), by="aspect").select("page_id", "side", "x", "w")


@query(f"SELECT page_id, floor(height * abs(sin(radians(page_id % 11 - 5))) + width * abs(cos(radians(page_id % 11 - 5))) + 0.5)::INT AS w, floor(height * abs(cos(radians(page_id % 11 - 5))) + width * abs(sin(radians(page_id % 11 - 5))) + 0.5)::INT AS h FROM {_DIMS}")
def deskew_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = G.canvas_after_rotation(F.col("width"), F.col("height"), F.col("page_id") % 11 - 5)
    return _dims(spark, sf_dir).select("page_id", w.alias("w"), h.alias("h"))
