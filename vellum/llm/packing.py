"""Best-fit packing with large-item matching.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Piece lengths are whole numbers up to the
capacity, so the histogram of lengths, at most ``capacity`` numbers however many documents there are, decides the
packing: lengths above a third of the capacity go at most two to a bin, matched greedily, the longest with the longest
that fits; shorter ones go, longest first, to the bins with the smallest gap that holds them. Bins with equal contents
are one group with a count. Pieces then get their places from their rank among the pieces of their length, which is
counted in salted groups, so that a length that a third of all pieces have is split as well.

Defined cases: null and empty texts are one piece that holds the end id alone; repeated rows are pieces of their own;
an empty table gives an empty result; further columns of pieces are kept, but for ones named sequence_id or offset,
which are replaced, and ones whose names begin with vellum_, which are dropped; further columns of documents are not
looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, read_bytes, written
from .textkit import WordTokenizer, released, slices, text_column

PIECES = "doc_id {id}, piece int, start long, length int, ids binary"


def encode_pieces(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids (unsigned 32 bits each, little-endian)."""
    model = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(model.value)
        for batch in batches:
            ids, texts = batch.column(0), text_column(batch.column(1))
            for lo, hi in slices(texts):
                flat, ends = tokenizer.encode(texts.slice(lo, hi - lo), end_id)
                starts = np.concatenate(([0], ends[:-1]))
                counts = -(-(ends - starts) // capacity)
                row = np.repeat(np.arange(hi - lo), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                begin = piece * capacity
                length = np.minimum(capacity, (ends - starts)[row] - begin)
                at = np.concatenate(([0], np.cumsum(length))) * 4
                held = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at.astype("<i4").tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype("i4")), pa.array(begin.astype("i8")), pa.array(length.astype("i4")), held],
                    ["doc_id", "piece", "start", "length", "ids"],
                )
        released(tokenizers=False)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, PIECES.format(id=id_type))


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal bins, (how many, [(length, times), ...]), for so many pieces of each length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[list] = []  # gap, bins, contents
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left.get(n):
            mate = next((m for m in large if m <= n and m <= capacity - n and left.get(m, 0) > (m == n)), None)
            if mate is None:
                count, held = left[n], [(n, 1)]
            elif mate == n:
                count, held = left[n] // 2, [(n, 2)]
            else:
                count, held = min(left[n], left[mate]), [(n, 1), (mate, 1)]
            for m, k in held:
                left[m] -= k * count
            groups.append([capacity - sum(m * k for m, k in held), count, held])
    groups.sort(key=lambda g: g[0])
    gaps = [g[0] for g in groups]

    def put(gap: int, count: int, held: list) -> None:
        i = bisect.bisect_left(gaps, gap)
        gaps.insert(i, gap)
        groups.insert(i, [gap, count, held])

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect.bisect_left(gaps, n)
            if i == len(groups):
                gap, bins, held = capacity, -(-left[n] // (capacity // n)), []
            else:
                gap, bins, held = groups.pop(i)
                gaps.pop(i)
            each = gap // n
            full = min(bins, left[n] // each)
            if full:
                put(gap - each * n, full, [*held, (n, each)])
                left[n] -= full * each
            bins -= full
            if bins and left[n]:  # fewer than fill one more bin
                put(gap - left[n] * n, 1, [*held, (n, left[n])])
                left[n] = 0
                bins -= 1
            if bins and held:
                put(gap, bins, held)
    return [(count, held) for _, count, held in groups]


def _slots(bins: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """By length and rank: which sequence and offset the pieces from this rank on have, and how many share a bin."""
    rows, used, first = [], {}, 0
    for count, held in bins:
        offset = 0
        for n, times in held:
            rows.append((n, used.get(n, 0), first, offset, times))
            used[n] = used.get(n, 0) + count * times
            offset += n * times
        first += count
    rows.sort()
    names = ("length", "rank", "sequence", "offset", "times")
    return {k: np.array([r[i] for r in rows], dtype="i8") for i, k in enumerate(names)}


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """pieces with doc_id, piece, start, length and any more columns, and sequence_id, offset for each of them."""
    spark = pieces.sparkSession
    n = bucket_count(spark)
    pieces = pieces.drop("sequence_id", "offset", *[c for c in pieces.columns if c.startswith("vellum_")])
    salted = pieces.withColumn("vellum_salt_", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(n)).cast("int"))
    counts = written(salted.groupBy("length", "vellum_salt_").agg(F.count(F.lit(1)).alias("vellum_many_")), "lengths")
    histogram = {r["length"]: r["many"] for r in counts.groupBy("length").agg(F.sum("vellum_many_").alias("many")).collect()}  # capacity rows at most
    slots = _slots(plan_bins(histogram, capacity), capacity)
    ahead = counts.withColumn("vellum_ahead_", F.sum("vellum_many_").over(Window.partitionBy("length").orderBy("vellum_salt_")) - F.col("vellum_many_")).drop("vellum_many_")
    order = ["doc_id", "piece", *[c for c in pieces.columns if c not in ("doc_id", "piece", "length")]]
    ranked = salted.withColumn("vellum_rank_", F.row_number().over(Window.partitionBy("length", "vellum_salt_").orderBy(*order)) - 1).join(ahead, ["length", "vellum_salt_"])
    ranked = ranked.select(*pieces.columns, (F.col("vellum_rank_") + F.col("vellum_ahead_")).alias("vellum_rank_"))
    keys = np.array([], dtype="i8") if not len(slots["length"]) else slots["length"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype("i8"), batch.column("vellum_rank_").to_numpy()
            at = np.empty(len(rank), dtype="i8")
            lo, hi = np.searchsorted(keys, length, "left"), np.searchsorted(keys, length, "right")
            for v in np.unique(length):
                own = length == v
                a, b = lo[own][0], hi[own][0]
                at[own] = a + np.searchsorted(slots["rank"][a:b], rank[own], "right") - 1
            turn = rank - slots["rank"][at]
            times = slots["times"][at]
            sequence = slots["sequence"][at] + turn // times
            offset = slots["offset"][at] + turn % times * length
            kept = [batch.column(c) for c in batch.schema.names if c != "vellum_rank_"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*[c for c in batch.schema.names if c != "vellum_rank_"], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed token sequences, from encode_pieces() and pack() of the same documents."""
    by = ["doc_id", "piece", "start"]
    parts = placed.select(*by, "sequence_id", "offset").join(pieces.select(*by, "ids"), by)
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.aggregate(whole, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
