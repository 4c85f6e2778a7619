"""Document fingerprints by Order MinHash.

A text's k-mers are of words. Each is numbered by its occurrence, so that repetition counts, and hashed. An order is a
hash that puts the k-mers on a ring; a signature is a point on the ring of one order, and ranks all k-mers of the text
by how far they follow that point. It selects the ``minima`` first ones, puts them back into the order of the text and
hashes their tuple. Two fingerprints agree on a signature if the same k-mers come first there and stand in the same
order, so their likeness follows the edit distance, in short texts too.

Points are evenly spaced, so one sorted array serves all signatures of an order: what follows a point is where that
point's arc of the ring begins in it, and of each arc only the first ``minima`` k-mers matter. Everything is array
functions on the row: texts aren't exploded and nothing is shuffled for a fingerprint.

Defined cases: null and empty texts are one empty word; texts of fewer than k words have k-mers that end early; texts
of fewer k-mers than ``minima`` select all; equal texts have equal fingerprints. A text may be as long as a string can
be (2**30 words). ``compare_edits`` also takes null ids (they come first), repeated ids (ordered by a hash of the text)
and repeated rows (each is a row of the result; one is the next document of the other); of an empty table it gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import first_keys, range_of
from .common import bucket_count, written

_SPACES = r"[\x20\x09-\x0D]+"
#: A k-mer is a long: 33 bits of hash, which order the ring, above 31 bits of position.
_BITS = 31
_POSITION = (1 << _BITS) - 1


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_POSITION))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_POSITION))


def _numbered(df: DataFrame, w: str, h: str, again: str, out: str, k: int) -> DataFrame:
    """out: the k-mers of the words w, ascending; h and again are columns on the way there.

    A k-mer's first occurrence has the k-mer's hash, later ones hash the number of the occurrence too. Only the
    repeated ones are hashed and sorted again.
    """
    hashed = F.transform(w, lambda x, i: _high(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])).bitwiseOR(i.cast("long")))
    df = df.withColumn(h, F.sort_array(hashed))
    repeats = lambda x, i: (i > 0) & (_high(x) == _high(F.get(h, i - 1)))
    df = df.withColumn(again, F.filter(h, repeats))
    begins = F.filter(F.sequence(F.lit(0), F.size(again) - 1), lambda i: (i == 0) | (_high(F.get(again, i)) != _high(F.get(again, i - 1))))
    runs = F.zip_with(begins, F.slice(begins, 2, F.size(begins)), lambda a, b: F.sequence(a, F.coalesce(b, F.size(again)) - 1))
    renumbered = F.transform(runs, lambda run: F.transform(run, lambda i, n: _high(F.xxhash64(_high(F.get(again, i)), n + 1)).bitwiseOR(_low(F.get(again, i)))))
    firsts = F.filter(h, lambda x, i: ~repeats(x, i))
    return df.withColumn(out, F.when(F.size(again) > 0, F.sort_array(F.concat(firsts, F.flatten(renumbered)))).otherwise(F.col(h)))


def _signatures(df: DataFrame, ring: str, m: str, heads: str, values: str, minima: int, points: int) -> DataFrame:
    """values: the signatures of the points of one ring, an ascending array of k-mers; m and heads are columns on the way."""
    # signed numbers: the arc of the smallest is the first
    arc = lambda x: F.shiftright(x, 64 - (points.bit_length() - 1)) + F.lit(points // 2)
    df = df.withColumn(m, F.filter(ring, lambda x, i: (i < minima) | (arc(x) != arc(F.get(ring, i - minima)))))
    df = df.withColumn(heads, F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (arc(F.get(m, i)) != arc(F.get(m, i - 1)))))

    def signature(i: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.least(F.size(m), F.lit(minima)) - 1), lambda j: F.get(m, F.pmod(i + j, F.size(m))))
        in_order = F.sort_array(F.transform(own, lambda x: F.shiftleft(_low(x), 64 - _BITS).bitwiseOR(F.shiftrightunsigned(x, _BITS))))
        return F.xxhash64(F.transform(in_order, lambda x: x.bitwiseAND(F.lit((1 << (64 - _BITS)) - 1)))).bitwiseAND(F.lit(0xFFFFFFFF))

    # a head is what follows all points after the arc of the head before it; points after the last arc go round
    before = lambda n: F.when(n > 0, arc(F.get(m, F.get(heads, n - 1)))).otherwise(F.lit(-1).cast("long"))
    runs = F.transform(heads, lambda i, n: F.array_repeat(signature(i), (arc(F.get(m, i)) - before(n)).cast("int")))
    df = df.withColumn(values, F.flatten(runs))
    return df.withColumn(values, F.concat(values, F.array_repeat(F.get(values, F.lit(0)), F.lit(points) - F.size(values))))


def with_fingerprint(df: DataFrame, text_col: str, out_col: str, *, k: int = 2, minima: int = 2, signatures: int = 64, orders: int = 2) -> DataFrame:
    """df with the fingerprint of a text column: an array of 32-bit numbers, one for each signature.

    Signatures are dealt out evenly to the orders; more orders give short texts more different signatures.
    """
    points = signatures // orders
    if points * orders != signatures or points < 2 or points & (points - 1):
        raise ValueError("signatures / orders must be a power of two from 2")
    w, h, again, r, m, heads = (f"{out_col}_{c}_" for c in ("words", "hashes", "again", "ring", "first", "heads"))
    parts = [f"{out_col}_{i}_" for i in range(orders)]
    df = df.withColumn(w, F.split(F.coalesce(F.col(text_col), F.lit("")), _SPACES))
    df = _numbered(df, w, h, again, r, k)
    for i, part in enumerate(parts):
        ring = r if i == 0 else f"{r}{i}_"
        if i:
            seed = F.lit(i)
            df = df.withColumn(ring, F.sort_array(F.transform(r, lambda x: _high(F.xxhash64(_high(x), seed)).bitwiseOR(_low(x)))))  # noqa: B023
        df = _signatures(df, ring, m, heads, part, minima, points).drop(m, heads, *([ring] if i else []))
    return df.withColumn(out_col, F.concat(*parts)).drop(w, h, again, r, *parts)


def shown(fingerprint: Column) -> Column:
    """As a string: eight hex digits a signature."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of signatures on which two fingerprints agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


_KEY = ["doc_id", "tie_", "copy_"]


def in_neighbourhoods(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Documents in ranges of ids (range_, doc_id, tie_, copy_, last_, text), and the window that orders a range.

    Each range also holds, as its last row, the first document of the range that follows (last_ = 1; after the last
    range: the first), so a lead in the window never needs another range. Edges are keys, ids with a hash of the text
    and a row number, so rows that share an id, or are the same, are split as well.
    """
    n = bucket_count(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("tie_"), F.monotonically_increasing_id().alias("copy_"), "text")
    docs = docs.select(range_of(docs, _KEY, first_keys(docs, _KEY, n)).alias("range_"), *_KEY, F.lit(0).alias("last_"), "text")
    first = docs.groupBy("range_").agg(F.min(F.struct("doc_id", "tie_")).alias("f"))
    every = Window.partitionBy(F.lit(0)).orderBy("range_")
    turn = F.coalesce(F.lag("range_").over(every), F.max("range_").over(Window.partitionBy(F.lit(0))))
    first = written(first.select(F.col("f.doc_id").alias("first_id"), F.col("f.tie_").alias("first_tie"), turn.alias("before")), "firsts")
    found = docs.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie_") == F.col("first_tie")))
    ends = found.groupBy("before", "doc_id", "tie_").agg(F.min("text").alias("text"))
    ends = ends.select(F.col("before").alias("range_"), "doc_id", "tie_", F.lit(0).cast("long").alias("copy_"), F.lit(1).alias("last_"), "text")
    return docs.unionByName(ends), Window.partitionBy("range_").orderBy("last_", *_KEY)


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **shape) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    The edited text has the last half of the characters replaced by the beginning of the next document, by id (ties by
    a hash of the text; null ids first; after the last document comes the first).
    """
    rows, window = in_neighbourhoods(docs, id_col=id_col, text_col=text_col)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("next_", F.lead("text").over(window))
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_", F.lit(1), half))
    rows = rows.select("range_", *_KEY, "last_", "text", n.cast("long").alias("n_chars"), F.when(F.col("last_") == 0, edited).otherwise(F.lit("")).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_fingerprint(rows, "text", "f", **shape).drop("text")
    rows = with_fingerprint(rows, "edited", "e", **shape).drop("edited")
    rows = rows.withColumn("g", F.lead("f").over(window)).where("last_ = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", shown(F.col("f")).alias("fingerprint"), shown(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"))
