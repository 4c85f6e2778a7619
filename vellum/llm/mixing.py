"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in an order shuffled by a hash of its id, gets a virtual finish time: the source's
cumulative words divided by the source's target. A second pass over the source goes on where the first ends, up to
``cap`` passes. All entries are then ordered by finish time across sources and cut where the words reach the budget.

Scale: prefix sums are two-level. Hash buckets split each source (a hot one too), buckets are summed first and only
those sums meet in one task; the cut is looked for in one narrow band of finish times.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; documents of size 0 are taken
0 words and one copy; repeated rows are documents of their own; an empty table gives an empty result; further columns
of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_count, written


def size_of(text: Column) -> Column:
    """Words between ASCII white space; of null 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(skey, source_size) to (skey, source_size, target).

    Sources in code point order take the weights in turn. share times all words is dealt out by weight; a target stops
    at cap times its source's size and the excess is dealt out again. Sorted by the level at which each source stops,
    the stopped sources are a prefix, so one pass finds the level.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("skey").asc_nulls_last())) - 1).withColumn("w", w)
    ranked = ranked.withColumn("most", F.lit(cap) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), "skey")
    everything = Window.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("before", F.sum("most").over(by_level) - F.col("most"))
        .withColumn("rest", F.sum("w").over(everything) - F.sum("w").over(by_level) + F.col("w"))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
        .withColumn("stops", F.col("level") >= F.col("most") / F.col("w"))
    )
    open_level = F.min_by(F.when(~F.col("stops"), F.col("level")), F.when(~F.col("stops"), F.col("most") / F.col("w"))).over(everything)
    return levels.withColumn("open", open_level).select(
        "skey", "source_size", F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("w") * F.col("open")).alias("target")
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 42,
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies (passes that take it), taken (words)."""
    spark = docs.sparkSession
    n = bucket_count(spark)
    key = F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 15)
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("skey"),
            size_of(F.col(text_col)).alias("size"),
            F.conv(key, 16, 10).cast("long").alias("key"),
        ),
        "sized",
    )
    sized = sized.withColumn("bucket", F.floor(F.col("key") / F.lit(2.0**60) * n).cast("int"))
    parts = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("ahead", F.sum("words").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("words"))
    targets = source_targets(sized.groupBy("skey").agg(F.sum("size").alias("source_size")), weights=weights, share=share, cap=cap)
    parts = parts.join(targets, "skey").drop("words")
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = written(
        sized.withColumn("words", F.sum("size").over(within))
        .join(parts, ["skey", "bucket"])
        .withColumn("words", F.col("words") + F.col("ahead"))
        .select("doc_id", "source", "skey", "size", "source_size", "target", "key", "words"),
        "timed",
    )
    budget = (timed.agg(F.sum("size")).first()[0] or 0) * float(share)
    taken = _taken(timed, budget, cap, n)
    copies = F.when(F.col("size") > 0, sum(taken[1:], taken[0])).otherwise(F.lit(1))
    return timed.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def _place(i: int, n: int) -> tuple[Column, Column]:
    """Of the entry of pass i: its band of finish times, and what orders it among all."""
    done = F.lit(i) * F.col("source_size") + F.col("words")
    finish = F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.lit(0.0))
    return F.floor(F.least(finish, F.lit(4.0)) * n).cast("int"), F.struct(
        finish.alias("finish"), F.lit(i).alias("pass"), F.col("skey").alias("skey"), F.col("key").alias("key"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size")
    )


def _taken(timed: DataFrame, budget: float, cap: int, n: int) -> list[Column]:
    """For each pass, 1 where the entry is among those whose words add up to the budget at most, else 0.

    Words are summed by band first. Only the band in which the budget ends is ordered entry by entry.
    """
    entries = timed.select("size", F.inline(F.array(*[F.struct(b.alias("band"), p.alias("place")) for b, p in (_place(i, n) for i in range(cap))])))
    bands = entries.groupBy("band").agg(F.sum("size").alias("words"))
    bands = bands.withColumn("upto", F.sum("words").over(Window.orderBy("band")))
    last = bands.where(F.col("upto") > F.lit(budget)).orderBy("band").first()
    if last is None:
        return [F.lit(1)] * cap
    ordered = entries.where(F.col("band") == last["band"]).withColumn(
        "upto", F.sum("size").over(Window.partitionBy("band").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    )
    ordered = ordered.where(F.col("upto") + F.lit(last["upto"] - last["words"]) <= F.lit(budget))
    cut = ordered.agg(F.max("place").alias("place")).first()["place"]
    at = F.lit(last["band"])
    if cut is None:
        return [(b < at).cast("int") for b, _ in (_place(i, n) for i in range(cap))]
    kinds = {"finish": "double", "pass": "int", "skey": "string", "key": "long", "doc_id": timed.schema["doc_id"].dataType, "size": "long"}
    cut = F.struct(*[F.lit(cut[k]).cast(t).alias(k) for k, t in kinds.items()])
    return [((b < at) | ((b == at) & (p <= cut))).cast("int") for b, p in (_place(i, n) for i in range(cap))]
