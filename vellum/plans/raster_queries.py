"""Small rasters: thresholds, profiles, bands, neighbourhoods, sizes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster as R
from ..operators import detect, kernels, pixels, prepare
from .layout_queries import _DIMS, _dims
from .registry import query
from .standins import SQL_RASTERS, rasters, read


@query(f"SELECT img_id, i::INT AS i, round(0.299::DOUBLE * px[i + 1] + 0.587::DOUBLE * px[i + 2] + 0.114::DOUBLE * px[i + 3], 6) AS g FROM (SELECT img_id, px, unnest(range(0, 61, 3)) AS i FROM {SQL_RASTERS})")
def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three numbers as red, green, blue."""
    p = rasters(spark, sf_dir).select("img_id", "px", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(3))).alias("i"))
    return p.select("img_id", "i", F.round(R.gray(*[F.get("px", F.col("i") + k) for k in range(3)]), 6).alias("g"))


@query(f"SELECT img_id, len(list_filter(px, lambda x: x > 128))::INT AS white, len(list_filter(px, lambda x: x <= 128))::INT AS black FROM {SQL_RASTERS}")
def threshold_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = R.binary(F.col("px"), 128)
    return rasters(spark, sf_dir).select("img_id", F.size(F.filter(b, lambda x: x == 255)).alias("white"), F.size(F.filter(b, lambda x: x == 0)).alias("black"))


@query(f"""WITH h AS (SELECT img_id, x, count(*) AS n FROM (SELECT img_id, unnest(px) AS x FROM {SQL_RASTERS}) GROUP BY ALL),
c AS (SELECT img_id, x, sum(n) OVER a AS w, sum(n * x) OVER a AS m, sum(n) OVER b AS n, sum(n * x) OVER b AS s FROM h WINDOW a AS (PARTITION BY img_id ORDER BY x), b AS (PARTITION BY img_id)),
v AS (SELECT img_id, x, CASE WHEN w < n THEN (m * n - s * w)::DOUBLE * (m * n - s * w) / (w * (n - w)) ELSE 0 END AS v FROM c)
SELECT img_id, arg_max(x, struct_pack(v := v, x := -x))::INT AS threshold FROM v GROUP BY img_id""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("img_id", R.otsu(F.col("px")).alias("threshold"))


_PROFILE = f"(SELECT img_id, r, list_sum(px[r * 8 + 1 : r * 8 + 8])::BIGINT AS ink FROM (SELECT img_id, px, unnest(range(8)) AS r FROM {SQL_RASTERS}))"


@query(f"SELECT img_id, r::INT AS r, ink FROM {_PROFILE}")
def projection_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("img_id", F.posexplode(R.row_sums(F.col("px"), 8)).alias("r", "ink"))


@query(f"""WITH t AS (SELECT *, ink < (max(ink) OVER p - min(ink) OVER p) / 2 + min(ink) OVER p AS low FROM {_PROFILE} WINDOW p AS (PARTITION BY img_id)),
g AS (SELECT img_id, r, r - row_number() OVER (PARTITION BY img_id ORDER BY r) AS island FROM t WHERE low)
SELECT img_id, min(r)::INT AS first_row, max(r)::INT AS last_row FROM g GROUP BY img_id, island""")
def ink_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rows below half of the range of the profile."""
    return pixels.bands(rasters(spark, sf_dir).select("img_id", F.posexplode(R.row_sums(F.col("px"), 8)).alias("r", "ink")), "img_id", "r", "ink")


@query(f"SELECT label, round(quantile_cont(t, 0.9), 9) AS p90 FROM (SELECT label, unnest(px)::DOUBLE AS t FROM {SQL_RASTERS}) GROUP BY label")
def p90_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rasters(spark, sf_dir).select("label", F.explode("px").alias("t"))
    return v.groupBy("label").agg(F.round(F.percentile("t", 0.9), 9).alias("p90"))


@query(f"SELECT img_id, i::INT AS i, round((x - 0.485 * 255) / (0.229 * 255), 9) AS v FROM (SELECT img_id, unnest(px) AS x, unnest(range(64)) AS i FROM {SQL_RASTERS})")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("img_id", F.posexplode("px").alias("i", "x")).select("img_id", "i", F.round(R.normalised(F.col("x"), 0.485, 0.229), 9).alias("v"))


@query(f"SELECT img_id, round(list_sum(list_transform(px, lambda x: CASE WHEN list_max(px) > list_min(px) THEN (x - list_min(px)) / (list_max(px) - list_min(px)) ELSE 0 END)), 9) AS total FROM {SQL_RASTERS}")
def min_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numeric import total

    return rasters(spark, sf_dir).select("img_id", F.round(total(R.min_max(F.col("px"))), 9).alias("total"))


_PIXELS = f"(SELECT img_id, (i % 8)::INT AS x, (i // 8)::INT AS y, v FROM (SELECT img_id, unnest(px) AS v, unnest(range(64)) AS i FROM {SQL_RASTERS}))"


@query(f"""SELECT a.img_id, a.x, a.y, least(greatest(5 * a.v - coalesce(l.v, a.v) - coalesce(r.v, a.v) - coalesce(u.v, a.v) - coalesce(d.v, a.v), 0), 255)::INT AS v FROM {_PIXELS} a
LEFT JOIN {_PIXELS} l ON l.img_id = a.img_id AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN {_PIXELS} r ON r.img_id = a.img_id AND r.y = a.y AND r.x = a.x + 1
LEFT JOIN {_PIXELS} u ON u.img_id = a.img_id AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN {_PIXELS} d ON d.img_id = a.img_id AND d.x = a.x AND d.y = a.y + 1""")
def sharpen3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross kernel with 5 in the middle, edges repeated."""
    return pixels.sharpened(pixels.exploded(rasters(spark, sf_dir), "img_id", 8), "img_id")


@query(f"SELECT a.img_id, a.x, a.y, min(b.v)::INT AS eroded, max(b.v)::INT AS dilated FROM {_PIXELS} a JOIN {_PIXELS} b ON a.img_id = b.img_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL")
def erode_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels.exploded(rasters(spark, sf_dir), "img_id", 8)
    low, high = pixels.box_filter(p, "img_id", 1, F.min), pixels.box_filter(p, "img_id", 1, F.max)
    return low.withColumnRenamed("v", "eroded").join(high.withColumnRenamed("v", "dilated"), ["img_id", "x", "y"])


@query(f"SELECT a.img_id, a.x, a.y, CASE WHEN a.v <= avg(b.v) - 25 THEN 255 ELSE 0 END AS v FROM {_PIXELS} a JOIN {_PIXELS} b ON a.img_id = b.img_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.img_id, a.x, a.y, a.v")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark against the mean of the 5 by 5 pixels around."""
    return pixels.adaptive(pixels.exploded(rasters(spark, sf_dir), "img_id", 8), "img_id", 2, 25)


@query(f"SELECT page_id, greatest(height * 4 - width, 0) AS add_w, greatest(width // 4 - height, 0) AS add_h FROM {_DIMS}")
def aspect_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = R.padding_to_aspect(F.col("width"), F.col("height"))
    return _dims(spark, sf_dir).select("page_id", w.alias("add_w"), h.alias("add_h"))


@query(f"""WITH s AS (SELECT page_id, greatest(1, floor(width * least(200 / width, 40 / height)))::INT AS w, greatest(1, floor(height * least(200 / width, 40 / height)))::INT AS h FROM {_DIMS})
SELECT page_id, w, h, ((200 - w) // 2)::INT AS dx, ((40 - h) // 2)::INT AS dy FROM s""")
def fit_and_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, dx, dy = R.fitted(F.col("width"), F.col("height"), 200, 40)
    return _dims(spark, sf_dir).select("page_id", w.alias("w"), h.alias("h"), dx.alias("dx"), dy.alias("dy"))


@query(f"""SELECT page_id, r AS ratio, (ceil(floor(width * r) / 32) * 32)::INT AS w, (ceil(floor(height * r) / 32) * 32)::INT AS h FROM (SELECT *, least(1.0::DOUBLE, 320 / greatest(width, height)) AS r FROM {_DIMS})""")
def canvas_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio, w, h = R.canvas(F.col("width"), F.col("height"), 320)
    return _dims(spark, sf_dir).select("page_id", ratio.alias("ratio"), w.alias("w"), h.alias("h"))


@query()
def components_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark components of each raster: label, area, box, mean."""
    return kernels.components(rasters(spark, sf_dir), "img_id", 8, threshold=128, neighbours=8)


@query()
def min_cost_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest way from the left edge to the right one, starting and ending at the middle row."""
    return kernels.cheapest_paths(rasters(spark, sf_dir), "img_id", 8)


@query()
def page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.cleaned(rasters(spark, sf_dir), "img_id", 8)


@query()
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines between the cheapest paths through the bands of low ink."""
    return kernels.segmented(rasters(spark, sf_dir), "img_id", 8, least_band=0)


@query()
def transcribed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from a page's raster to its text, with the stand-in recogniser."""
    from .pipelines import transcribed

    return transcribed(rasters(spark, sf_dir).withColumnRenamed("img_id", "page_id"), 8, least_band=0)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters as pages: every third one half as high and twice as wide."""
    return rasters(spark, sf_dir).select("img_id", F.when(F.col("img_id") % 3 == 0, 16).otherwise(8).alias("w"), "px")


@query()
def page_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpened, halved, turned upright, cleaned, numbered."""
    return prepare.prepared(_pages(spark, sf_dir), "img_id", borders=True, skew_options={"most": 3.0, "step": 0.5}, border_options={"length": 6, "gap": 2, "thick": 1})


@query()
def page_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.finished(_pages(spark, sf_dir), "img_id", most=3.0, step=0.5)


@query(f"""WITH h AS (SELECT *, len(px) // w AS h FROM (SELECT img_id, px, CASE WHEN img_id % 3 = 0 THEN 16 ELSE 8 END AS w FROM {SQL_RASTERS})),
p AS (SELECT img_id, w, h, w AS full_w, 'whole' AS side, 0 AS x0, px FROM h WHERE w <= h UNION ALL SELECT img_id, w // 2, h, w, 'left', 0, px FROM h WHERE w > h UNION ALL SELECT img_id, w - w // 2, h, w, 'right', w // 2, px FROM h WHERE w > h)
SELECT img_id, side, w::INT AS w, md5(array_to_string(list_transform(range(w * h), lambda i: px[(i // w) * full_w + x0 + i % w + 1]), ',')) AS digest FROM p""")
def pages_halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prepare.halved(_pages(spark, sf_dir), "img_id")
    return own.select("img_id", "side", "w", F.md5(F.array_join(F.col("px").cast("array<string>"), ",").cast("binary")).alias("digest"))


@query(f"""WITH g AS (SELECT a.img_id, a.x, a.y, a.v, max(b.v) AS m FROM {_PIXELS} a JOIN {_PIXELS} b ON a.img_id = b.img_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)
SELECT img_id, sum(CASE WHEN m > 0 THEN round_even(v / m * 255, 0)::INT ELSE 255 END * (1 + x + 8 * y))::BIGINT AS weighed FROM g GROUP BY img_id""")
def background_evened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divided by the brightest of the 3 by 3 pixels around; a weighed sum of all pixels."""
    own = prepare.chained(_pages(spark, sf_dir).withColumn("w", F.lit(8)), "img_id", [partial(prepare.evened, size=3)])
    return own.select("img_id", F.aggregate(F.transform("px", lambda v, i: v.cast("long") * (1 + i)), F.lit(0).cast("long"), lambda s, x: s + x).alias("weighed"))


@query(f"""SELECT a.img_id, sum(CASE WHEN m > 240 THEN 40 ELSE 0 END)::BIGINT AS total FROM (SELECT a.img_id, a.x, a.y, max(b.v) AS m FROM {_PIXELS} a JOIN {_PIXELS} b ON a.img_id = b.img_id AND b.y BETWEEN a.y - 2 AND a.y + 1 AND b.x BETWEEN a.x - 8 AND a.x + 7 GROUP BY ALL) a GROUP BY 1""")
def mask_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prepare.chained(_pages(spark, sf_dir).withColumn("w", F.lit(8)), "img_id", [prepare.mask_levels])
    return own.select("img_id", F.aggregate("px", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query()
def fitted_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled up to four times as wide as high, then resized."""
    return prepare.chained(_pages(spark, sf_dir), "img_id", [partial(prepare.fitted, h=10, w=40)])


@query()
def word_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters, and rasters turned around, as score maps of text and links."""
    text = F.transform("px", lambda v: v / 255)
    maps = rasters(spark, sf_dir).select("img_id", F.lit(8).alias("w"), text.alias("text"), F.reverse(text).alias("link"))
    return detect.detected(maps, "img_id", text_least=0.55, link_least=0.7, peak_least=0.6, least_area=3)


@query()
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the middles of the edges, around the ink."""
    return kernels.shortest_paths(rasters(spark, sf_dir), "img_id", 8)


@query("SELECT vec_id AS img_id, list_sum(list_transform(embedding, lambda x: floor(least(greatest(x::DOUBLE, 0), 1) * 255)::INT))::BIGINT AS total FROM embeddings")
def heat_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), R.heat_levels(F.col("embedding").cast("array<double>")).alias("l"))
    return own.select("img_id", F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
