"""Columns over token sequences: encoding, padding, decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def padded(ids: Column, size: Column | int, pad: Column | int) -> Column:
    """At least so many ids, filled up with pad."""
    size, pad = (x if isinstance(x, Column) else F.lit(x) for x in (size, pad))
    return F.concat(ids, F.array_repeat(pad, F.greatest(size - F.size(ids), F.lit(0))))


def encoded(chars: Column, vocab: Column, unknown: Column | int) -> Column:
    """Characters to ids by a map; those it lacks become unknown."""
    unknown = unknown if isinstance(unknown, Column) else F.lit(unknown)
    return F.transform(chars, lambda x: F.coalesce(F.try_element_at(vocab, x), unknown))


def encoded_with_end(label: Column, vocab: Column, *, unknown: int, end: int, pad: int, most: int = 20) -> Column:
    """Lower-cased, cut to ``most`` characters, ended, padded to one more than that."""
    chars = F.slice(F.filter(F.split(F.lower(label), ""), lambda x: x != ""), 1, most)
    return padded(F.concat(encoded(chars, vocab, unknown), F.array(F.lit(end))), most + 1, pad)


def cut_at_markers(text: Column, *markers: str) -> Column:
    for m in markers:
        text = F.substring_index(text, m, 1)
    return text


def without_ignored(ids: Column) -> Column:
    return F.filter(ids, lambda x: x != IGNORED)


def pad_ignored(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, IGNORED).otherwise(x))


def argmax(scores: Column) -> Column:
    """The first index, from 0, of the greatest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_k(scores: Column, k: int) -> Column:
    """Indices, from 0, of the k greatest, ties by index."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def ctc_greedy(steps: Column, blank: int, most: int | None = None) -> Column:
    """Best id of each step; repeats collapsed, blanks dropped, cut to ``most``."""
    best = F.transform(steps, argmax)
    kept = F.filter(best, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(best, i - 1))))
    return F.slice(kept, 1, most) if most else kept


def until(ids: Column, end: int) -> Column:
    """Ids before the first end id."""
    at = F.array_position(ids, end).cast("int")
    return F.when(at > 0, F.slice(ids, 1, F.greatest(at - 1, F.lit(0)))).otherwise(ids)


def repeats_ngram(ids: Column, n: int) -> Column:
    """Whether some run of n ids occurs twice."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids) - n + 1, F.lit(1))), lambda i: F.slice(ids, i, n))
    return (F.size(ids) > n) & (F.size(F.array_distinct(grams)) < F.size(grams))
