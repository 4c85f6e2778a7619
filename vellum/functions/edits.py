"""Edit distances of whole batches, by Myers' bit vectors in whole numbers of any length.

A column of the distance table is two bit vectors, so a step costs the length of the longer text by the word size of the
machine, not a cell at a time; what both texts begin and end with is left out first. Texts may be as long as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements that make b of a; of strings by characters, of lists by entries."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    lo, n = 0, len(b)
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : n - hi]
    if not b:
        return len(a)
    at: dict = {}
    wanted = set(b)
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    where = {x: _bits(own, len(a)) for x, own in at.items() if x in wanted}
    every, last, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = every, 0
    for x in b:
        eq = where.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (every & ~(diagonal | up))
        left = up & diagonal
        score += (right >> last & 1) - (left >> last & 1)
        right = right << 1 | 1
        up = (left << 1 | ~(diagonal | right)) & every
        down = right & diagonal & every
    return score


def _bits(places: list[int], n: int) -> int:
    if len(places) < 64:
        out = 0
        for i in places:
            out |= 1 << i
        return out
    held = bytearray(n // 8 + 1)
    for i in places:
        held[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(held, "little")


@F.pandas_udf(IntegerType())
def _of_texts(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(IntegerType())
def _of_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def of_texts(a: Column, b: Column) -> Column:
    """By code points; null if either is."""
    return _of_texts(a, b)


def of_words(a: Column, b: Column) -> Column:
    """Of two arrays, by entries; null if either is."""
    return _of_words(a, b)
