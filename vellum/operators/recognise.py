"""Recognisers of line images: a function from rasters to strings behind Arrow batches, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Recogniser = Callable[[list[np.ndarray]], list[str]]


def stub() -> Recogniser:
    """A deterministic stand-in for a model: a letter for each column, by its darkness."""
    return lambda rasters: ["".join(chr(97 + int(c) % 26) for c in (255 - r).sum(0)) for r in rasters]


def recognised(lines: DataFrame, load: Callable[[], Recogniser] = stub, *, batch: int = 16) -> DataFrame:
    """lines (px, w and any key columns) with a column text. load is called once for each worker's task."""
    keys = [c for c in lines.columns if c not in ("px", "w")]
    fields = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            px, w = b.column(b.schema.get_field_index("px")), b.column(b.schema.get_field_index("w")).to_pylist()
            rasters = [px[i].values.to_numpy(zero_copy_only=False).reshape(-1, w[i]) for i in range(len(b))]
            texts = [t for lo in range(0, len(b), batch) for t in model(rasters[lo : lo + batch])]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], pa.array(texts, pa.string())], [*keys, "text"])

    return lines.mapInArrow(run, f"{fields}, text string" if fields else "text string")


def beam_search(scores: Callable[[list[list[int]]], np.ndarray], start: int, end: int, *, beams: int = 10, steps: int = 20) -> list[int]:
    """The likeliest sequence that beams of so many beginnings find; scores gives the log probabilities of what follows each beginning.

    Beginnings that have ended stay in the beam with their score; ties go to the smaller tokens.
    """
    held: list[tuple[float, list[int]]] = [(0.0, [start])]
    for _ in range(steps):
        going = [b for b in held if b[1][-1] != end or len(b[1]) == 1]
        if not going:
            break
        follow = scores([b[1] for b in going])
        new = [(total + float(p), [*tokens, token]) for (total, tokens), row in zip(going, follow, strict=True) for token, p in enumerate(row)]
        held = sorted([b for b in held if b[1][-1] == end and len(b[1]) > 1] + new, key=lambda b: (-b[0], b[1]))[:beams]
    return held[0][1][1:]


def word_boxes(pages: DataFrame, engine: Callable[[], Callable[[np.ndarray], list[tuple[int, int, int, int, int]]]], key: str = "page_id") -> DataFrame:
    """key, level, x1, y1, w, h: what an OCR engine, loaded once a task, finds on each page (px, w)."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = engine()
        for b in batches:
            rows = [(k, *map(int, r)) for k, w, px in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) if px.is_valid for r in read(px.values.to_numpy(zero_copy_only=False).reshape(-1, w))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field(0).type), *[pa.array(c, pa.int32()) for c in columns[1:]]], [key, "level", "x1", "y1", "w", "h"])

    return pages.select(key, "w", "px").mapInArrow(run, f"{key} {kind}, level int, x1 int, y1 int, w int, h int")
