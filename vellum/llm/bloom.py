"""Bloom filters in built-in functions: bits are OR-ed on the executors, and one array of words judges keys in place."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass
class Bloom:
    """bits and hashes for keys of any type; a filter never misses a key that it was built of."""

    bits: int
    hashes: int
    seed: int = 0
    words: Column | None = None

    @classmethod
    def sized(cls, keys: int, rate: float, *, seed: int = 0, most_bytes: int | None = None) -> Bloom:
        """For so many keys and that rate of false positives; within most_bytes the rate rises instead."""
        bits = max(64, math.ceil(keys * math.log(1 / rate) / math.log(2) ** 2))
        return cls(min(bits, 8 * most_bytes) if most_bytes else bits, max(1, round(math.log2(1 / rate))), seed)

    def positions(self, key: Column) -> list[Column]:
        h = F.xxhash64(key, F.lit(self.seed))
        a, b = F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit(0x7FFFFFFF))
        return [F.pmod(a + F.lit(j) * b, F.lit(self.bits)) for j in range(self.hashes)]

    def built(self, keys: DataFrame) -> Bloom:
        """With the bits of the column key: one row of bits / 8 bytes."""
        at = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("p"))
        words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
        every = keys.sparkSession.range(-(-self.bits // 64)).withColumnRenamed("id", "w")
        whole = every.join(words, "w", "left").select(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("s"))
        held = written(whole.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("words")), "bloom")
        self.words = held.scalar()
        return self

    def holds(self, key: Column) -> Column:
        tests = [F.getbit(F.element_at(self.words, (F.floor(p / 64) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self.positions(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out
