"""Near-duplicate embeddings by an epsilon grid order join.

Vectors are scaled to length 1, where a cosine of c is a distance of epsilon = sqrt(2 - 2c), and projected on the
leading principal dimensions, which never lengthens a distance. They are sorted by label and grid cell of width epsilon
on those dimensions and cut into blocks, intervals of that sequence. Blocks whose bounds are farther apart than epsilon
are never paired; paired ones are halved recursively, skipping intervals that are provably distant, and what remains is
multiplied out. Cosines are taken in double precision.

Scale: equal vectors of a label are one representative with a count. A pair of blocks gives a count for each vector and
the links of a spanning forest, not its pairs, so a group of near copies costs rows in proportion to its size. The
principal dimensions come from sums over all vectors; they bear on speed only.

Defined cases: labels that are null, vectors that are null, empty, zero, or hold null or non-finite components, and
null ids link with nothing; vectors of different lengths link with nothing of another length; rows that repeat an id
are vectors of their own but one node; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import written
from .components import components, forest

BLOCK, LEAF = 1024, 128
#: Lengths of vectors, and coordinates of each, that principal axes are found for.
LENGTHS, DIMS = 16, 256


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    v = v.astype("f8")
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _moments(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for dim, rows in _by_size(batch.column(0)):
                x = unit(rows[1])[:, :dims]
                x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
                total = {} if total is None else total
                total[dim] = total.get(dim, 0) + x.T @ x
        for dim, t in (total or {}).items():
            i, j = np.triu_indices(len(t))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim)), pa.array(i), pa.array(j), pa.array(t[i, j])], ["dim", "i", "j", "v"])

    return run


def _by_size(column: pa.Array) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Of a column of lists: by length, the rows and the matrix."""
    n = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    at = np.concatenate(([0], np.cumsum(n)))
    return [(int(d), (rows := np.flatnonzero(n == d), flat[(at[rows][:, None] + np.arange(d)[None]).reshape(-1)].reshape(len(rows), d))) for d in np.unique(n)]


def principal_axes(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """For each of the LENGTHS most frequent lengths of vectors, the leading axes of its unit vectors in their first DIMS coordinates.

    At most LENGTHS * DIMS**2 / 2 numbers come to the driver. Any orthonormal axes are right, these are good ones.
    """
    sized = vectors.select("embedding", F.size("embedding").alias("dim"))
    common = [r["dim"] for r in sized.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]
    sums = sized.where(F.col("dim").isin(common)).select("embedding").mapInArrow(_moments(DIMS), "dim long, i long, j long, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in sums.collect():
        n = min(r["dim"], DIMS) + 1
        found.setdefault(r["dim"], np.zeros((n, n)))[r["i"], r["j"]] = r["v"]
    out: dict[int, np.ndarray] = {}
    for dim, t in found.items():
        n = len(t) - 1
        t = t + np.triu(t, 1).T
        mean = t[:n, n] / t[n, n]
        axes = np.linalg.eigh(t[:n, :n] / t[n, n] - np.outer(mean, mean))[1][:, ::-1][:, : min(most, n)]
        out[dim] = np.concatenate((axes, np.zeros((dim - n, axes.shape[1]))))
    return out


def _axes_of(axes: dict[int, np.ndarray], dim: int, most: int) -> np.ndarray:
    """Lengths without axes of their own have those of their first coordinates."""
    return axes[dim] if dim in axes else np.eye(dim)[:, : min(most, dim)]


def _cells(axes: dict[int, np.ndarray], width: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((len(batch), most), dtype="i8")
            for dim, (rows, v) in _by_size(batch.column("embedding")):
                got = np.floor(unit(v) @ _axes_of(axes, dim, most) / width).astype("i8")
                cells[rows, : got.shape[1]] = got
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, i]) for i in range(most)]], [*batch.schema.names, *[f"cell_{i}" for i in range(most)]])

    return run


_BLOCK = "block long, label string, dim long, low array<double>, high array<double>, ids binary, many binary, vectors binary"


def _blocks(axes: dict[int, np.ndarray], most: int):
    def emit(number: int, label: str, dim: int, ids: np.ndarray, many: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        p = unit(v) @ _axes_of(axes, dim, most)
        values = [[number], [label], [dim], [p.min(0).tolist()], [p.max(0).tolist()], [ids.astype("<i8").tobytes()], [many.astype("<i8").tobytes()], [v.astype("<f8").tobytes()]]
        types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, types, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        key, held, size = None, [], 0

        def cut() -> pa.RecordBatch:
            return emit(number, *key, *[np.concatenate(x) for x in zip(*held, strict=True)])

        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            dims = batch.column("embedding").value_lengths().to_numpy()
            edges = np.flatnonzero((labels[1:] != labels[:-1]) | (dims[1:] != dims[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(batch)], strict=True):
                if lo == hi:
                    continue
                own = (labels[lo], int(dims[lo]))
                while lo < hi:
                    if held and (own != key or size == BLOCK):
                        yield cut()
                        number, held, size = number + 1, [], 0
                    key, take = own, min(hi - lo, BLOCK - size)
                    part = batch.slice(lo, take)
                    held.append((part.column("rep").to_numpy(), part.column("many").to_numpy(), part.column("embedding").flatten().to_numpy().reshape(take, own[1])))
                    size += take
                    lo += take
        if held:
            yield cut()

    return run


def _joined(axes: dict[int, np.ndarray], most: int, least: float, width: float):
    def pairs(a: np.ndarray, b: np.ndarray, same: bool, dim: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, links) of the leaves that aren't provably distant."""
        pa_, pb = (x @ _axes_of(axes, dim, most) for x in (a, b))
        todo = [(0, len(a), 0, len(b))]
        while todo:
            i, k, j, m = todo.pop()
            if same and m <= i + 1:  # below the diagonal
                continue
            gap = np.maximum(0, np.maximum(pa_[i:k].min(0) - pb[j:m].max(0), pb[j:m].min(0) - pa_[i:k].max(0)))
            if (gap * gap).sum() > width * width:
                continue
            if k - i <= LEAF and m - j <= LEAF:
                links = a[i:k] @ b[j:m].T >= least
                if same:
                    links &= np.arange(j, m)[None] > np.arange(i, k)[:, None]
                if links.any():
                    yield i, j, links
            elif k - i >= m - j:
                h = (i + k) // 2
                todo += [(i, h, j, m), (h, k, j, m)]
            else:
                h = (j + m) // 2
                todo += [(i, k, j, h), (i, k, h, m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                same, dim = row["a"] == row["b"], row["dim"]
                side = []
                for c in "ab":
                    ids, many, v = (np.frombuffer(row[f"{n}_{c}"], dtype=t) for n, t in (("ids", "<i8"), ("many", "<i8"), ("vectors", "<f8")))
                    side.append((ids, many, unit(v.reshape(len(ids), dim))))
                (ids_a, many_a, a), (ids_b, many_b, b) = side
                count_a, count_b = np.zeros(len(a), dtype="i8"), np.zeros(len(b), dtype="i8")
                stars: list[tuple[int, int]] = []
                for i, j, links in pairs(a, b, same, dim):
                    x, y = ids_a[i : i + links.shape[0]], ids_b[j : j + links.shape[1]]
                    count_a[i : i + len(x)] += links @ many_b[j : j + len(y)]
                    count_b[j : j + len(y)] += many_a[i : i + len(x)] @ links
                    stars += _stars(x, y, links)
                out: dict[int, int] = {}
                for ids, counts in ((ids_a, count_a), (ids_b, count_b)):
                    for v, n in zip(ids[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
                        out[v] = out.get(v, 0) + n
                up = [(x, y) for x, y in forest(stars).items() if x != y]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*out, *[x for x, _ in up]], pa.int64()), pa.array([*[None] * len(out), *[y for _, y in up]], pa.int64()), pa.array([*out.values(), *[0] * len(up)], pa.int64())], ["a", "b", "n"]
                )

    return run


def _stars(x: np.ndarray, y: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Each linked row and column with the smallest id of its component, by spreading minima until nothing changes."""
    top = np.iinfo("i8").max
    rows = np.where(links.any(1), x, top)
    while True:
        cols = np.minimum(np.where(links, rows[:, None], top).min(0), np.where(links.any(0), y, top))
        new = np.minimum(np.where(links, cols[None], top).min(1), rows)
        if (new == rows).all():
            break
        rows = new
    return [(int(a), int(b)) for ids, least in ((x, rows), (y, cols)) for a, b in zip(ids[least < top], least[least < top], strict=True)]


def near_duplicates(vectors: DataFrame, *, least: float = 0.98, axes_most: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links (vectors of its label with a cosine of ``least`` or more), component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    real = rows.where(sound).where(finite)
    width = math.sqrt(max(0.0, 2 - 2 * least)) * (1 + 1e-9) + 1e-9
    reps = written(real.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")), "vectors")
    axes = principal_axes(reps, axes_most)
    cells = [f"cell_{i}" for i in range(axes_most)]
    kind = vectors.schema[vector_col].dataType.simpleString()
    placed = reps.mapInArrow(_cells(axes, width, axes_most), f"label string, embedding {kind}, rep long, many long, " + ", ".join(f"{c} long" for c in cells))
    order = ["label", F.size("embedding"), *cells, "rep"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks(axes, axes_most), _BLOCK), "blocks")
    # blocks are paired by the cells of the first dimension that they, or their surroundings, touch
    cell = lambda c, by: F.floor((F.col(c)[0] + F.lit(by)) / width)
    bounds = blocks.select("block", "label", "dim", "low", "high")
    left = bounds.select(F.col("block").alias("a"), "label", "dim", F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(cell("low", 0), cell("high", 0))).alias("at"))
    right = bounds.select(F.col("block").alias("b"), "label", "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(cell("low", -width), cell("high", width))).alias("at"))
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= width * width
    pairs = left.join(right, ["label", "dim", "at"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dim").distinct()
    sides = [blocks.select(F.col("block").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("ids", "many", "vectors")]) for c in "ab"]
    found = pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_joined(axes, axes_most, least, width), "a long, b long, n long")
    found = written(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    labels = components(found.where("b is not null").select("a", "b"))
    known = reps.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("links_"), F.coalesce("component", "rep").alias("component_"))
    linked = real.join(known, ["label", "embedding"]).select("vec_id", F.col("links_").cast("long").alias("n_links"), F.col("component_").alias("component_id"))
    alone = rows.where(~F.coalesce(sound, F.lit(False)) | ~F.coalesce(finite, F.lit(False)))
    out = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
