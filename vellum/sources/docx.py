"""Paragraphs of DOCX files as a Python data source: spark.read.format("docx_paragraphs").load(folder)."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs(data: bytes) -> list[str]:
    """The text of each paragraph, tabs and line breaks included, stripped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        parts = [x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")]
        out.append("".join(parts).strip())
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """doc, ord (from 0), text of all paragraphs. Files come through Spark's binary source, so any store it reads will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = paragraphs(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], ["doc", "ord", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInArrow(run, "doc string, ord int, text string")


def transcription(docx: DataFrame, skip: str = "PDF p") -> DataFrame:
    """Paragraphs without page headings."""
    return docx.where(~F.startswith("text", F.lit(skip)))


def pages(docx: DataFrame, marker: str = r"PDF|END OF EXTRACT") -> DataFrame:
    """doc, page (from 0), text: a paragraph with a marker closes a page; empty paragraphs, and what follows the last marker, are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("ord")
    closed = docx.withColumn("mark_", F.col("text").rlike(marker).cast("int"))
    closed = closed.withColumn("page", F.sum("mark_").over(w)).withColumn("all_", F.sum("mark_").over(Window.partitionBy("doc")))
    kept = closed.where((F.col("mark_") == 0) & (F.col("text") != "") & (F.col("page") < F.col("all_")))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])
    return kept.groupBy("doc", "page").agg(F.array_join(whole, "\n").alias("text"))


def docx_bytes(texts: list[str]) -> bytes:
    """The smallest DOCX that holds these paragraphs."""
    escape = lambda t: re.sub("[&<>]", lambda m: {"&": "&amp;", "<": "&lt;", ">": "&gt;"}[m[0]], t)
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in texts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
