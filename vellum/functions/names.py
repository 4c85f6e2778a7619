"""File-name grammars as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_number(file: Column) -> Column:
    """The number of a line crop, in levels: 3_2 is [3, 2]; without a number [-1]."""
    n = F.regexp_extract(file, r"_line_(\d+(_\d+)?)\.png$", 1)
    return F.when(n == "", F.array(F.lit(-1))).otherwise(F.transform(F.split(n, "_"), lambda x: x.try_cast("int")))


def is_segment(file: Column, page: Column) -> Column:
    return F.startswith(file, page) & F.contains(file, F.lit("_line_")) & F.endswith(file, F.lit(".png"))


def number_before(file: Column, ending: str) -> Column:
    """The number right before an ending, else -1."""
    return F.coalesce(F.regexp_extract(file, r"(\d+)" + re.escape(ending), 1).try_cast("long"), F.lit(-1).cast("long"))


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^./]*$", "")


def has_extension(file: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(file).rlike("(" + "|".join(re.escape(e) for e in extensions) + ")$")


def labelled_files(files: DataFrame, file_col: str, *, skip: tuple[str, ...] = ()) -> DataFrame:
    """FILENAME and IDENTITY, the stem, of files without certain endings."""
    f = F.col(file_col)
    kept = files.where(~has_extension(f, skip)) if skip else files
    return kept.select(f.alias("FILENAME"), stem(f).alias("IDENTITY"))


def book_code(path: Column) -> Column:
    """The part of a PDF's path that names its pages: the 10th to the 20th character."""
    return F.substring(path, 10, 11)
