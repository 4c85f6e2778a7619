"""Positions, splits, batches and draws: over rows wider than their order, ties, nulls, groups."""

import random

from pyspark.sql import functions as F

from vellum.functions import ranges
from vellum.operators import align, metrics, splits


def test_positions_are_a_permutation(spark):
    """Two million rows of several columns: each position once, in order; splits of the exact size."""
    n = 2_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.col("id").alias("v"), F.concat(F.lit("t"), F.col("id") % 97).alias("t"))
    own = ranges.numbered(df, ["k"])
    r = own.agg(F.count("*"), F.countDistinct("i_"), F.min("i_"), F.max("i_"), F.min("all_"), F.max("all_")).first()
    assert tuple(r) == (n, n, 0, n - 1, n, n)
    edge = own.where(F.col("i_").isin(0, 1000, n - 1)).orderBy("i_").select("k").collect()
    hashes = df.select("k").orderBy("k").toPandas()["k"]
    assert [x["k"] for x in edge] == [hashes[0], hashes[1000], hashes[n - 1]]
    parts = {x["split"]: x["count"] for x in splits.head_tail(df, ["k"], 9, 10).groupBy("split").count().collect()}
    assert parts == {"train": n * 9 // 10, "test": n - n * 9 // 10}


def test_positions_by_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", 'q"\\x']), rng.choice([None, 1, 2, 3]), i, f"w{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a int, b int, w string").repartition(3)
    got = {r["b"]: (r["i_"], r["all_"]) for r in ranges.numbered(df, ["a", "b"], ["g"]).collect()}
    for g in (None, "a", "b", 'q"\\x'):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == [(i, len(own)) for i in range(len(own))]
    assert ranges.numbered(df.limit(0), ["b"]).count() == 0
    ties = ranges.numbered(df.withColumn("c", F.lit(1)), ["c"])
    assert sorted(r["i_"] for r in ties.collect()) == list(range(500))


def test_draws_and_batches(spark):
    df = spark.range(101).select("id", F.col("id").alias("x"), F.lit("t").alias("t"))
    draws = splits.with_replacement(df, ["id"], 300, 5)
    assert draws.count() == 300 and draws.select("id").distinct().count() > 60
    assert {r["batch"]: r["count"] for r in splits.batched(df, ["id"], 16).groupBy("batch").count().collect()} == {**dict.fromkeys(range(6), 16), 6: 5}
    parts = splits.shuffled(df, ["id"], 1, 3, 4)
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 75, "test": 26}
    again = splits.shuffled(df.repartition(7), ["id"], 1, 3, 4)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, again.collect()))


def test_renumbered(spark):
    df = spark.createDataFrame([("b", 2), ("a", 10), ("b", 1)], "f string, n int")
    assert [(r["f"], r["n"], r["index"]) for r in align.renumbered(df, ["f", "n"], 7).orderBy("index").collect()] == [("a", 10, 7), ("b", 1, 8), ("b", 2, 9)]


def test_joined_batches(spark):
    rows = [("s", i, f"a b{i}", f"a b{i}" if i % 3 else f"a x{i} y") for i in range(7)]
    df = spark.createDataFrame(rows, "g string, n int, r string, p string")
    got = {r["batch"]: (r["edits"], r["words"]) for r in metrics.joined_wer(df, "r", "p", "g", ["n"], 4).collect()}
    assert got == {0: (4, 8), 1: (2, 6)}


def test_macro_means(spark):
    df = spark.createDataFrame([("g", "a b c d e", "a b c d e"), ("g", "a b c d e f", "a b c d x"), ("g", "", "z"), ("g", "a b", "c d")], "g string, r string, p string")
    r = metrics.macro_means(df, "r", "p", ["g"]).first()
    second = 2.718281828459045 ** (1 - 6 / 5) * (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25
    assert r["n_lines"] == 4
    assert abs(r["wer"] - (0 + 2 / 6 + 0 + 1) / 4) < 1e-9
    assert abs(r["cer"] - (0 + 3 / 11 + 0 + 2 / 3) / 4) < 1e-9
    assert abs(r["bleu"] - (1 + second) / 4) < 1e-9
    b = metrics.bundle(df, "r", "p", ["g"]).first()
    assert b["n_lines"] == 4 and 0 < b["bleu"] < 1
