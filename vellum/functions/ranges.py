"""Positions over all rows of an order, without gathering them.

Rows are dealt to ranges of the order. Which range a row belongs to is a function of its own columns and of the ranges'
first keys, so plans may compute it as often as they like, over whatever columns, and always agree.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_keys(df: DataFrame, key: list[str], n: int) -> list[str]:
    """The first keys, as JSON, of all but the first of at most n ranges of about equal size: one string a range."""
    own = df.select(*key).repartitionByRange(n, *key).withColumn("range_", F.spark_partition_id())
    firsts = own.groupBy("range_").agg(F.min(F.struct(*key)).alias("first_"))
    return [r[0] for r in firsts.orderBy("first_").select(F.to_json("first_", {"ignoreNullFields": "false"})).collect()[1:]]


def range_of(df: DataFrame, key: list[str], firsts: list[str]) -> Column:
    """How many first keys are at or below a row's key: a binary search in a constant array."""
    if not firsts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([json.loads(x) for x in firsts])), f"array<{df.select(F.struct(*key).alias('k')).schema['k'].dataType.simpleString()}>")
    own = F.struct(*key)

    def moved(at: Column, step: int) -> Column:
        # bound by a lambda, or each step would hold the one before it several times
        ahead = lambda lo: lo + F.when((lo + step <= len(firsts)) & (F.get(table, lo + (step - 1)) <= own), F.lit(step)).otherwise(F.lit(0))
        return F.get(F.transform(F.array(at), ahead), F.lit(0))

    at = F.lit(0)
    for bit in reversed(range(len(firsts).bit_length())):
        at = moved(at, 1 << bit)
    return at


def numbered(df: DataFrame, order: list[str], by: list[str] = ()) -> DataFrame:
    """df with i_, each row's position from 0 among all rows, or those of its group, and all_, how many there are.

    A range's rows are numbered within it; only the ranges' sizes (a row for each range and group) meet in one task.
    Rows that are equal in the order have positions of their own, in any order among them, and share a range.
    """
    key = [*by, *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("range_", range_of(df, key, first_keys(df, key, n)))
    group = [f"by_{i}_" for i in range(len(by))]
    sizes = dealt.groupBy("range_", *[F.col(c).alias(g) for c, g in zip(by, group, strict=True)]).agg(F.count(F.lit(1)).alias("size_"))
    every = Window.partitionBy(*(group or [F.lit(0)]))
    sizes = sizes.withColumn("ahead_", F.sum("size_").over(every.orderBy("range_")) - F.col("size_")).withColumn("all_", F.sum("size_").over(every)).drop("size_").withColumnRenamed("range_", "of_")
    dealt = dealt.withColumn("in_", F.row_number().over(Window.partitionBy("range_", *by).orderBy(*order)) - 1)
    same = F.col("range_") == F.col("of_")
    for c, g in zip(by, group, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(g))
    return dealt.join(sizes, same).withColumn("i_", F.col("in_") + F.col("ahead_")).drop("range_", "of_", "in_", "ahead_", *group)
