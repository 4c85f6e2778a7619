"""What the driver's tables stand in for: transcribed lines, pages, boxes, rasters, frames, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Letters that old print interchanges: what a recogniser confuses.
CONFUSED = ("uvfs", "vusf")
#: All characters of the corpora beyond ASCII. The SQL side counts bytes, so it maps each to a control character of one byte.
_BEYOND = "ÊÄñÉßêÈÑäÜèéÍüöÖÓçíÇóÁáÚ"
_BYTES = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(14, 30)])
SQL_BYTES = f"translate({{}}, '{_BEYOND}', {_BYTES})"

SQL_LINES = "(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, line_no (from 0), text."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(T.lines(F.col("text"))).alias("line_no", "text"))


def recognised(c: Column) -> Column:
    """What a recogniser that confuses letters makes of a line."""
    return F.translate(c, *CONFUSED)


SQL_RECOGNISED = "translate({}, 'uvfs', 'vusf')"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, x1, y1, x2, y2, ord: boxes from order lines; ord numbers a page's boxes by all of their coordinates."""
    from pyspark.sql import Window

    q = F.col("l_quantity").cast("long")
    b = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") % 700).alias("x1"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 900).alias("y1"), (20 + q * 5).alias("w"), (10 + q % 17 * 4).alias("h")
    )
    b = b.select("page_id", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))
    return b.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("x1", "y1", "x2", "y2")))


SQL_BOXES = """(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x1, y1, x2, y2) AS ord FROM (
  SELECT page_id, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM (
    SELECT l_orderkey AS page_id, l_partkey % 700 AS x1, (l_suppkey * 7 + l_linenumber * 13) % 900 AS y1, 20 + l_quantity::BIGINT * 5 AS w, 10 + l_quantity::BIGINT % 17 * 4 AS h FROM lineitem)))"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, label, px: 8 by 8 pixels from 0 to 255."""
    e = read(spark, sf_dir, "embeddings")
    px = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int"))
    return e.select(F.col("vec_id").alias("img_id"), "label", px.alias("px"))


SQL_RASTERS = "(SELECT vec_id AS img_id, label, list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255)::INT) AS px FROM embeddings)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, frames: 8 frames of 8 numbers."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("id", "label", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("v", t * 8 + 1, 8)).alias("frames"))


SQL_FRAMES = "(SELECT vec_id AS id, label, list_transform(range(8), lambda t: (embedding::DOUBLE[])[t * 8 + 1 : t * 8 + 8]) AS frames FROM embeddings)"
