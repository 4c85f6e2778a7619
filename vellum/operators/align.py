"""Pages, lines and crops brought together: by marker, stem, position, running offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.ranges import first_keys, numbered, range_of


def runs(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Numbers runs of equal values within a group, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn(out, new.cast("long")).withColumn(out, F.sum(out).over(w))


def page_text(lines: DataFrame, page: list[str], order: list[str], text: str) -> DataFrame:
    """One row a page: its lines in order, joined by line ends."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("text_")))), lambda s: s["text_"])
    return lines.groupBy(*page).agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(whole, "\n").alias("text"))


def pages_between_markers(paragraphs: DataFrame, doc: str, order: str, marker: Column, text: str) -> DataFrame:
    """A marker begins a page; what stands before the first one, and empty paragraphs, belong to none."""
    w = Window.partitionBy(doc).orderBy(order)
    own = paragraphs.withColumn("mark_", marker.cast("long")).withColumn("page", F.sum("mark_").over(w))
    own = own.where((F.col("mark_") == 0) & (F.col("page") > 0) & (F.col(text) != ""))
    return page_text(own, [doc, "page"], [order], text)


def dehyphenated(lines: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """Lines that end in a hyphen go on in the next one: doc, part, text."""
    w = Window.partitionBy(doc).orderBy(order)
    goes_on = F.coalesce(F.endswith(F.lag(text).over(w), F.lit("-")), F.lit(False))
    own = lines.withColumn("new_", (~goes_on).cast("long")).withColumn("part", F.sum("new_").over(w))
    own = own.withColumn(text, F.when(F.endswith(text, F.lit("-")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(F.col(text)))
    whole = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("text_")))), lambda s: s["text_"])
    return own.groupBy(doc, "part").agg(F.array_join(whole, "").alias("text"))


def by_stem(left: DataFrame, right: DataFrame, file: str) -> DataFrame:
    """Files of the same name, whatever their endings."""
    return left.withColumn("stem_", names.stem(F.col(file))).drop(file).join(right.withColumn("stem_", names.stem(F.col(file))).drop(file), "stem_").drop("stem_")


def without_partner(left: DataFrame, right: DataFrame, file: str) -> DataFrame:
    return left.withColumn("stem_", names.stem(F.col(file))).join(right.select(names.stem(F.col(file)).alias("stem_")), "stem_", "left_anti").drop("stem_")


def positional(crops: DataFrame, texts: DataFrame, page: list[str], crop_order: list[str], text_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The n-th crop with the n-th line of its page; and the crops that are left over, to be reported."""
    a = crops.withColumn("n", F.row_number().over(Window.partitionBy(*page).orderBy(*crop_order)))
    b = texts.withColumn("n", F.row_number().over(Window.partitionBy(*page).orderBy(*text_order)))
    return a.join(b, [*page, "n"]), a.join(b.select(*page, "n"), [*page, "n"], "left_anti")


def zipped(a: DataFrame, b: DataFrame, key: str, a_order: str, b_order: str) -> DataFrame:
    """Per key, pairs of both sides' n-th entries, as many as the shorter side has."""
    left = a.groupBy(key).agg(F.array_sort(F.collect_list(a_order)).alias("a_"))
    right = b.groupBy(key).agg(F.array_sort(F.collect_list(b_order)).alias("b_"))
    n = F.least(F.size("a_"), F.size("b_"))
    return left.join(right, key).select(key, F.arrays_zip(F.slice("a_", F.lit(1), n).alias("a"), F.slice("b_", F.lit(1), n).alias("b")).alias("pairs"))


def by_running_offset(pages: DataFrame, lines: DataFrame, group: str, page: str, count: str, line: str, first: int = 0) -> DataFrame:
    """Lines of a group dealt out to its pages, each taking ``count`` of them in order.

    Each page names its lines, so this is an equi-join, not a range join. Running offsets are two-level: counts are
    summed by the range of pages first, and a group of very many pages is several ranges.
    """
    key = [group, page]
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = pages.withColumn("range_", range_of(pages, key, first_keys(pages, key, n)))
    sums = own.groupBy(F.col(group).alias("group_"), F.col("range_").alias("of_")).agg(F.sum(count).alias("sum_"))
    sums = sums.withColumn("ahead_", F.sum("sum_").over(Window.partitionBy("group_").orderBy("of_")) - F.col("sum_")).drop("sum_")
    own = own.withColumn("in_", F.sum(count).over(Window.partitionBy(group, "range_").orderBy(page)))
    own = own.join(sums, F.col(group).eqNullSafe(F.col("group_")) & (F.col("range_") == F.col("of_")))
    own = own.withColumn("hi_", F.col("in_") + F.col("ahead_") + first).drop("range_", "of_", "in_", "ahead_", "group_")
    own = own.withColumn("lo_", F.col("hi_") - F.col(count)).where(F.col(count) > 0)
    own = own.withColumn(line, F.explode(F.sequence(F.col("lo_"), F.col("hi_") - 1))).drop("lo_", "hi_")
    return own.join(lines, [group, line])


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key, the last: as a maximum, which is pre-aggregated."""
    rest = [c for c in df.columns if c not in (*key, *order)]
    top = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("top_"))
    return top.select(*key, "top_.*")


def renumbered(df: DataFrame, order: list[str], base: int, out: str = "index") -> DataFrame:
    """A running number from base over all rows."""
    return numbered(df, order).withColumn(out, F.col("i_") + base).drop("i_", "all_")


def crop_names(words: DataFrame, page: str, line: str, order: list[str], first: int = 0) -> DataFrame:
    """words with number, running over all pages in order, and file: number and line, by which a word is found again."""
    own = numbered(words, [page, line, *order]).withColumn("number", F.col("i_") + first).drop("i_", "all_")
    return own.withColumn("file", F.concat("number", F.lit(";"), line, F.lit(".png")))


def in_both(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the other side has as well."""
    return left.join(right.select(*key).distinct(), key, "left_semi")


def chunked(rows: DataFrame, order: list[str], size: int, part: int = 1, of: int = 1) -> DataFrame:
    """The first part / of rows, each with the chunk of ``size`` rows it's in."""
    own = numbered(rows, order)
    return own.where(F.col("i_") < F.floor(F.col("all_") * part / of)).withColumn("chunk", F.floor(F.col("i_") / size)).drop("i_", "all_")
