"""Pages and logs as they arrive. The batch operators take the same frames; only sources and sinks differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text


def arriving_lines(spark: SparkSession, folder: str, *, most_files: int = 100) -> DataFrame:
    """path, line_no, text of transcription files that are added to a folder."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", most_files).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(text.lines(F.col("value"), keep_last_empty=False)).alias("line_no", "text"))


def arriving_log(spark: SparkSession, folder: str, schema, *, most_files: int = 100) -> DataFrame:
    """A log of Parquet files; ts without a zone is taken as UTC, which a watermark needs."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_means(log: DataFrame, *, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, mean of values; state older than the watermark is dropped."""
    own = log.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return own.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean")


def scored_into(spark: SparkSession, pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Edits and lengths of arriving (ref, pred) pairs, appended to a table as they come; error rates are sums over it."""
    rows = pairs.select("*", text.char_edits(F.col("ref"), F.col("pred")).alias("edits"), F.length("ref").alias("chars"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
