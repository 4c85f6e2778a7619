"""The ways from scans to transcriptions as compositions of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, kernels, layout, metrics, recognise


def transcribed(pages: DataFrame, width: int, *, load: Callable[[], recognise.Recogniser] = recognise.stub, **options) -> DataFrame:
    """page rasters (page_id, px of one width) to page_id, n_lines, text: cleaned, cut into lines, recognised, joined.

    A line's pixels are sliced out of its page's array in the same stage; nothing is shuffled but the short texts.
    """
    clean = kernels.cleaned(pages, "page_id", width)
    segments = kernels.segmented(clean, "page_id", width, **options)
    crops = segments.join(clean, "page_id").select("page_id", F.col("line").alias("line_no"), F.slice("px", F.col("first_row") * width + 1, (F.col("end_row") - F.col("first_row")) * width).alias("px"), F.lit(width).alias("w"))
    return align.page_text(recognise.recognised(crops, load), ["page_id"], ["line_no"], "text")


def samples(polygons: DataFrame, transcription: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Detected polygons and transcribed lines of pages to pairs (page_id, line_no, box, text), and the boxes without a line."""
    lines = layout.line_boxes(polygons, **options)
    return align.positional(lines, transcription, ["page_id"], ["line_no"], ["text_no"])


def evaluated(predictions: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Character error rates of predicted pages against their transcriptions, by position of the line."""
    pairs, _ = align.positional(predictions.withColumnRenamed("text", "pred"), truth, by, ["line_no"], ["text_no"])
    return metrics.corpus_cer(pairs, "text", "pred", by)
