"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Each node of the pairs to the smallest node of its component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


#: Links that one task contracts at once.
CHUNK = 250_000


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def stars() -> pa.RecordBatch:
        own = [(x, r) for x, r in forest(held).items() if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([r for _, r in own], pa.int64())], ["a", "b"])

    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(held) >= CHUNK:
            yield stars()
            held = []
    yield stars()


def _contracted(links: DataFrame, many: int) -> DataFrame:
    """Links replaced by the stars of each chunk's components."""
    return written(links.coalesce(max(1, -(-many // CHUNK))).mapInArrow(_shorten, "a long, b long"), "contracted")


def _are_stars(links: DataFrame) -> bool:
    """Whether each node is linked once, to one that isn't linked further."""
    many = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    further = links.select("b").distinct().join(links.select(F.col("a").alias("b")), "b", "left_semi")
    return not many.limit(1).count() and not further.limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (node, component): of each linked node, the smallest node it reaches.

    In rounds, until links are stars: chunks of links are replaced by the stars of their own components; then larger
    neighbours are linked to a node's smallest neighbour, and smaller ones likewise. Each half step is a pre-aggregated
    minimum and a join, which Spark can split at a hot node, and ends in a written table.
    """
    links = written(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    while True:
        links = _contracted(links, links.count())
        if _are_stars(links):
            nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(links.select("b", "b").distinct())
        # large star: every neighbour above u is linked to the smallest of u and its neighbours
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        links = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", F.col("a")).alias("b"))
        # small star: u and its neighbours below it are linked to the smallest of them
        low = written(links.where("a <> b").distinct(), "large-star")
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        links = written(low.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "small-star")
