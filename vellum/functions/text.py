"""Columns over transcribed text: cleaning, splitting, edit distances."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import edits

#: What Python's str.strip() and split() take for white space, within ASCII.
WHITE = " \t\n\r\x0b\x0c"
_RUNS = r"[ \t\n\r\x0B\x0C]+"


def without_punctuation(c: Column) -> Column:
    """ASCII punctuation removed."""
    return F.translate(c, string.punctuation, "")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def tokens(c: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(c, _RUNS), lambda w: w != "")


def characters(c: Column) -> Column:
    """Code points as strings."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def count_of(c: Column, mark: str) -> Column:
    """How often a character stands in a text."""
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def character_counts(df: DataFrame, text: str) -> DataFrame:
    """ch, n (all places), docs (texts that hold it): counted by task, so a few rows for each task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = Counter(), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = Counter(t or "")
                total.update(own)
                held.update(own.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([held[x] for x in total], pa.int64())], ["ch", "n", "docs"])

    counted = df.select(F.col(text).cast("string")).mapInArrow(run, "ch string, n long, docs long")  # no more rows than there are characters
    return counted.groupBy("ch").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def lines(c: Column, *, keep_last_empty: bool = True) -> Column:
    """Text lines; a final line end gives an empty last line, or none if it isn't kept."""
    parts = F.split(c, "\n")
    if keep_last_empty:
        return parts
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def clean_label(c: Column) -> Column:
    """A label without augmentation tags: up to the first underscore, then up to the first blank."""
    return F.substring_index(F.substring_index(c, "_", 1), " ", 1)


def unknown_to_space(c: Column) -> Column:
    return stripped(F.replace(c, F.lit("[UNK]"), F.lit(" ")))


def modern_spelling(c: Column) -> Column:
    """Old print to modern letters: c with cedilla to z, q with tilde to que, a vowel with tilde to vowel and n; n with tilde stays."""
    c = F.translate(c, "çÇ", "zZ")
    c = F.replace(F.replace(c, F.lit("q̃"), F.lit("que")), F.lit("ṽ"), F.lit("vn"))
    for tilde, plain in (("ã", "an"), ("ẽ", "en"), ("ĩ", "in"), ("õ", "on"), ("ũ", "un")):
        c = F.replace(c, F.lit(tilde), F.lit(plain))
    return F.regexp_replace(c, "([aeiou])̃", "$1n")


def match_key(c: Column) -> Column:
    """Words that differ only in letters that old print interchanges (u and v, long s and f) have one key."""
    return F.translate(F.lower(c), "vfſ", "uss")


def char_edits(a: Column, b: Column) -> Column:
    """Edit distance by code points."""
    return F.when(a == b, F.lit(0)).otherwise(edits.of_texts(a, b))


def word_edits(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays."""
    return F.when(a == b, F.lit(0)).otherwise(edits.of_words(a, b))


def similarity_pair(a: Column, b: Column) -> Column:
    """Of a reference and a prediction: one less the character error rate, and the rate; without characters 1 and 0."""
    rate = F.when(F.length(a) > 0, char_edits(a, b) / F.length(a)).otherwise(F.lit(0.0))
    return F.array(1 - rate, rate)
