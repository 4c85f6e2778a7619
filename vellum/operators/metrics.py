"""Error rates of predictions, grouped."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import text as T
from ..functions.ranges import numbered


def corpus_cer(df: DataFrame, ref: str, pred: str, by: list[str]) -> DataFrame:
    """Edits over reference characters, summed first; 0 without characters."""
    own = df.select(*by, T.char_edits(F.col(ref), F.col(pred)).alias("edits"), F.length(ref).alias("chars"))
    out = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("edits").alias("edits"), F.sum("chars").alias("chars"))
    return out.withColumn("cer", F.when(F.col("chars") > 0, F.col("edits") / F.col("chars")).otherwise(F.lit(0.0)))


def mean_cer(df: DataFrame, ref: str, pred: str, by: list[str]) -> DataFrame:
    """The mean of lines' own rates; empty lines count 0."""
    rate = F.when(F.length(ref) > 0, T.char_edits(F.col(ref), F.col(pred)) / F.length(ref)).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg(rate), 9).alias("cer"))


def exact_matches(df: DataFrame, ref: str, pred: str, by: list[str]) -> DataFrame:
    hit = (F.col(ref) == F.col(pred)).cast("long")
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("matches"))
    return out.withColumn("accuracy", F.col("matches") / F.col("n"))


def _word_scores(df: DataFrame, ref: str, pred: str, by: list[str]) -> DataFrame:
    r, p = T.tokens(F.col(ref)), T.tokens(F.col(pred))
    return df.select(*by, r.alias("r_"), p.alias("p_"), F.length(ref).alias("chars")).select(*by, T.word_edits(F.col("r_"), F.col("p_")).alias("edits"), F.size("r_").alias("words"), "chars")


def corpus_wer(df: DataFrame, ref: str, pred: str, by: list[str]) -> DataFrame:
    out = _word_scores(df, ref, pred, by).groupBy(*by).agg(F.sum("edits").alias("edits"), F.sum("words").alias("words"))
    return out.withColumn("wer", F.when(F.col("words") > 0, F.col("edits") / F.col("words")).otherwise(F.lit(0.0)))


def wer_per_char(df: DataFrame, ref: str, pred: str, by: list[str]) -> DataFrame:
    rate = F.when((F.col("words") > 0) & (F.col("chars") > 0), F.col("edits") / F.col("words") / F.col("chars")).otherwise(F.lit(0.0))
    return _word_scores(df, ref, pred, by).groupBy(*by).agg(F.round(F.avg(rate), 12).alias("wer_per_char"))


def in_batches(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """df with batch: so many rows of a group at a time, in order, numbered from 0."""
    return numbered(df, order, by).withColumn("batch", F.floor(F.col("i_") / size)).drop("i_", "all_")


def batch_cer(df: DataFrame, ref: str, pred: str, group: str, order: list[str], size: int) -> DataFrame:
    """The mean over batches of their edits over their characters."""
    own = in_batches(df.select(group, *order, T.char_edits(F.col(ref), F.col(pred)).alias("edits"), F.length(ref).alias("chars")), [group], order, size)
    own = own.groupBy(group, "batch").agg((F.sum("edits") / F.greatest(F.sum("chars"), F.lit(1))).alias("cer"))
    return own.groupBy(group).agg(F.count(F.lit(1)).alias("batches"), F.round(F.avg("cer"), 9).alias("batch_cer"))


def joined_wer(df: DataFrame, ref: str, pred: str, group: str, order: list[str], size: int) -> DataFrame:
    """group, batch, edits, words, wer: the texts of a batch, joined by blanks, taken as one text."""
    own = in_batches(df.select(group, *order, F.col(ref).alias("r_"), F.col(pred).alias("p_")), [group], order, size)
    rows = F.array_sort(F.collect_list(F.struct(*order, "r_", "p_")))
    whole = own.groupBy(group, "batch").agg(rows.alias("rows_"))
    text = lambda c: F.array_join(F.transform("rows_", lambda x: x[c]), " ")
    out = _word_scores(whole.select(group, "batch", text("r_").alias("r_"), text("p_").alias("p_")), "r_", "p_", [group, "batch"]).drop("chars")
    return out.withColumn("wer", F.when(F.col("words") > 0, F.col("edits") / F.col("words")).otherwise(F.lit(0.0)))


def _bleu_counts(n: int):
    """For two columns of texts: words of either, and for sizes up to n the clipped hits and the n-grams of the second."""

    @F.pandas_udf(ArrayType(LongType()))
    def counts(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(ref: str, pred: str) -> list[int]:
            r, p = ref.split(), pred.split()
            out = [len(r), len(p)]
            for k in range(1, n + 1):
                total = max(0, len(p) - k + 1)
                if r == p:
                    out += [total, total]
                    continue
                have = Counter(zip(*[r[i:] for i in range(k)], strict=False))
                found = Counter(zip(*[p[i:] for i in range(k)], strict=False))
                out += [sum(min(v, have[g]) for g, v in found.items() if g in have), total]
            return out

        return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return counts


def corpus_bleu(df: DataFrame, ref: str, pred: str, by: list[str], n: int = 4) -> DataFrame:
    """Clipped n-gram precisions up to n, their geometric mean, and the brevity penalty.

    Clipping is a text's own matter, so n-grams are counted where the text lies, and only sums are shuffled.
    """
    text = lambda c: F.array_join(T.tokens(F.col(c)), " ")
    counted = df.select(*by, _bleu_counts(n)(text(ref), text(pred)).alias("c"))
    names = ["ref_words", "pred_words", *[x for k in range(1, n + 1) for x in (f"hit_{k}", f"all_{k}")]]
    sums = counted.groupBy(*by).agg(*[F.sum(F.get("c", F.lit(i))).alias(c) for i, c in enumerate(names)])
    logs = sum((F.ln(F.col(f"hit_{k}") / F.col(f"all_{k}")) for k in range(2, n + 1)), F.ln(F.col("hit_1") / F.col("all_1")))
    brief = F.when(F.col("pred_words") >= F.col("ref_words"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref_words") / F.col("pred_words")))
    bleu = F.when(F.least(*[f"hit_{k}" for k in range(1, n + 1)]) > 0, brief * F.exp(logs / n)).otherwise(F.lit(0.0))
    return sums.select(*by, "ref_words", "pred_words", F.round(bleu, 9).alias("bleu"))


def sentence_bleu(c: Column, n: int = 4) -> Column:
    """The score of one text from its counts: without a common word, or words, 0; a size without hits counts as the smallest positive number, so it's as good as 0."""
    at = lambda i: F.get(c, F.lit(i)).cast("double")
    least = F.lit(2.2250738585072014e-308)
    precision = lambda k: F.greatest(F.when(at(2 * k + 1) > 0, at(2 * k) / at(2 * k + 1)).otherwise(F.lit(0.0)), least)
    logs = sum((F.ln(precision(k)) for k in range(2, n + 1)), F.ln(precision(1)))
    brief = F.when(at(1) > at(0), F.lit(1.0)).otherwise(F.exp(1 - at(0) / at(1)))
    return F.when((at(1) > 0) & (at(2) > 0), brief * F.exp(logs / n)).otherwise(F.lit(0.0))


def macro_means(df: DataFrame, ref: str, pred: str, by: list[str]) -> DataFrame:
    """n_lines and the means over texts of their own character and word error rates and BLEU; what can't be divided counts 0."""
    r, p = T.tokens(F.col(ref)), T.tokens(F.col(pred))
    rate = lambda edits, size: F.when(size > 0, edits / size).otherwise(F.lit(0.0))
    own = df.select(*by, ref, pred, r.alias("r_"), p.alias("p_"), F.when(F.length(ref) > 0, F.length(ref)).otherwise(0).alias("chars"))
    own = own.select(*by, rate(T.char_edits(F.col(ref), F.col(pred)), F.col("chars")).alias("cer"), rate(T.word_edits(F.col("r_"), F.col("p_")), F.size("r_")).alias("wer"), _bleu_counts(4)(F.array_join("r_", " "), F.array_join("p_", " ")).alias("c"))
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg("cer"), 9).alias("cer"), F.round(F.avg("wer"), 9).alias("wer"), F.round(F.avg(sentence_bleu(F.col("c"))), 9).alias("bleu"))


def bundle(df: DataFrame, ref: str, pred: str, by: list[str]) -> DataFrame:
    """by, cer, wer, bleu: what an evaluation reports, each over its whole group."""
    cer, wer, bleu = corpus_cer(df, ref, pred, by), corpus_wer(df, ref, pred, by), corpus_bleu(df, ref, pred, by)
    return cer.select(*by, "n_lines", "cer").join(wer.select(*by, "wer"), by).join(bleu.select(*by, "bleu"), by)


def opcode_rate(df: DataFrame, ref: str, pred: str, out: str = "rate") -> DataFrame:
    """df with a sum that passes for an error rate: over the stretches in which a matcher finds two strings to differ, where
    each ends in the prediction, by the reference's length; 1 for an empty reference. Kept for comparison only."""

    @F.pandas_udf("double")
    def rate(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        one = lambda x, y: sum(c[-1] for c in SequenceMatcher(None, x, y).get_opcodes() if c[0] != "equal") / len(x) if x else 1.0
        return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return df.withColumn(out, rate(F.col(ref), F.col(pred)))
