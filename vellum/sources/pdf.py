"""Pages of PDF files; rendering needs a library that isn't a dependency."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Render = Callable[[bytes, int], Iterator[bytes]]


def _default(data: bytes, dpi: int) -> Iterator[bytes]:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("rendering PDF pages needs PyMuPDF, or a render function of your own") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        for page in doc:
            yield page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72)).tobytes("png")


def read_pages(spark: SparkSession, path: str, *, dpi: int = 300, render: Render = _default) -> DataFrame:
    """book, page_no (from 0), png of all PDF files of a folder. Filter on page_no for the first pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                book = name.rsplit("/", 1)[-1].removesuffix(".pdf")
                for i, png in enumerate(render(data, dpi)):
                    yield pa.RecordBatch.from_arrays([pa.array([book]), pa.array([i], pa.int32()), pa.array([png], pa.binary())], ["book", "page_no", "png"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInArrow(run, "book string, page_no int, png binary")
