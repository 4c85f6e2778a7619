"""Files of a digitisation project: listings, images, transcriptions, polygons, samples, configuration; and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

IMAGES, MASKS, TRUTHS = (".jpg", ".jpeg", ".gif", ".png", ".pgm", ".tif", ".tiff"), (".bmp",), (".xml", ".gt", ".txt")
SAMPLES = "FILENAME string, IDENTITY string"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind (image, mask, truth, other) of all files below a folder; zip files are skipped. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.when(names.has_extension(F.col("path"), IMAGES), "image").when(names.has_extension(F.col("path"), MASKS), "mask").when(names.has_extension(F.col("path"), TRUTHS), "truth")
    return files.where(~names.has_extension(F.col("path"), (".zip",))).withColumn("kind", F.coalesce(kind, F.lit("other")))


def count_files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> int:
    return listing(spark, path).where(names.has_extension(F.col("path"), extensions)).count()


def images(spark: SparkSession, path: str, *, colour: bool = False) -> DataFrame:
    """path, h, w, px (row-major gray, 0 to 255) of images; colour ones are weighted, an alpha channel is dropped.

    With colour px has red, green and blue of each pixel, one after the other; gray ones have three equal numbers.
    """
    import numpy as np
    import pyarrow as pa

    raw = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for batch in batches:
            px = []
            for h, w, n, data in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3, 4)], strict=True):
                a = np.frombuffer(data, dtype="u1").reshape(h, w, n)
                # Spark's image source has blue first
                if colour:
                    own = np.repeat(a, 3, axis=2) if n == 1 else a[..., 2::-1]
                else:
                    own = a[..., 0] if n == 1 else np.rint(a[..., :3] @ np.array([0.114, 0.587, 0.299])).astype("i4")
                px.append(own.reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(px, pa.list_(pa.int32()))], ["path", "h", "w", "px"])

    return raw.mapInArrow(run, "path string, h int, w int, px array<int>")


def transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """book, page_no, line_no (from 0), text of files book/page/page.txt; a last line end gives no line."""
    from ..functions import text

    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = F.regexp_extract("path", r"([^/]+)/(\d+)/\d+\.txt$", 1), F.regexp_extract("path", r"([^/]+)/(\d+)/\d+\.txt$", 2).try_cast("int")
    return files.select(parts[0].alias("book"), parts[1].alias("page_no"), F.posexplode(text.lines(F.col("value"), keep_last_empty=False)).alias("line_no", "text"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """page_no, ord, poly of files res_{page}.txt: a line of x, y, x, y, ... a polygon; lines of less than four corners are skipped.

    A polygon's place in its file orders it, so files, small ones, are read whole.
    """
    files = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "res_*.txt").load(path).select(F.regexp_extract("_metadata.file_path", r"res_(?:image_)?(\d+)", 1).cast("int").alias("page_no"), "value")
    rows = files.select("page_no", F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    return rows.select("page_no", "ord", F.transform(F.split("line", ","), lambda x: F.trim(x).try_cast("double").cast("int")).alias("poly")).where(F.size("poly") >= 8)


def box_groups(spark: SparkSession, path: str) -> DataFrame:
    """page_no, line_no, ord, c of files in which ; ends each line's group of boxes."""
    files = spark.read.format("text").option("wholetext", "true").load(path).select(F.regexp_extract("_metadata.file_path", r"(\d+)_sorted\.txt$", 1).try_cast("int").alias("page_no"), "value")
    groups = files.select("page_no", F.posexplode(F.split("value", ";")).alias("line_no", "g"))
    rows = groups.select("page_no", "line_no", F.posexplode(F.filter(F.split("g", "\n"), lambda x: F.trim(x) != "")).alias("ord", "row"))
    return rows.select("page_no", "line_no", "ord", F.transform(F.split("row", ","), lambda x: F.trim(x).cast("int")).alias("c"))


def polygon_lines(polygons: DataFrame) -> DataFrame:
    """value: a polygon a line, whole numbers between commas; for a text sink with lineSep \\r\\n."""
    return polygons.select(F.array_join(F.transform("poly", lambda x: x.cast("int").cast("string")), ",").alias("value"))


def write_polygons(polygons: DataFrame, path: str) -> None:
    polygon_lines(polygons).write.option("lineSep", "\r\n").text(path)


def read_samples(spark: SparkSession, path: str, schema: str = SAMPLES) -> DataFrame:
    """Named columns, never positions."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.option("header", "true").csv(path)


def write_pages(pages: DataFrame, path: str, page: str = "page_no", text: str = "text") -> None:
    """One folder of text a page."""
    pages.select(page, F.col(text).alias("value")).write.partitionBy(page).text(path)


def write_predictions(words: DataFrame, path: str, *, page: str, line: str, order: str, text: str = "text") -> None:
    """One folder of text a page, a line of blank-separated words for each line."""
    from ..operators import align

    own = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("text_")))), lambda x: x["text_"])
    lines = words.groupBy(page, line).agg(F.array_join(own, " ").alias(text))
    write_pages(align.page_text(lines, [page], [line], text).select(page, F.col("text").alias(text)), path, page, text)


def config(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A JSON configuration as one row; numbers are coerced, what can't be is an error."""
    return spark.createDataFrame([(text,)], "c string").select(F.from_json("c", schema, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def datasets(spark: SparkSession, slots: list[str | None], schema: str = SAMPLES) -> DataFrame:
    """The rows of all dataset slots that aren't empty."""
    found = [read_samples(spark, s, schema) for s in slots if s]
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def without_prefix(state, prefix: str = "module."):
    """Keys of a map without a prefix."""
    return F.transform_keys(state, lambda k, _: F.when(F.startswith(k, F.lit(prefix)), F.substring(k, F.lit(len(prefix) + 1), F.length(k))).otherwise(k))


def nth_line(lines: DataFrame, n: int, by: list[str], order: str = "line_no", text: str = "text") -> DataFrame:
    """The n-th line, from 1, of each file; files with fewer give null."""
    return lines.groupBy(*by).agg(F.max(F.when(F.col(order) == n - 1, F.col(text))).alias(text))


