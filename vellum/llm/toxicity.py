"""Toxicity by a weighted lexicon.

The lexicon holds beginnings of words with weights, learned from labelled rows as log odds of the documents that hold
them. Texts are folded first (case, homoglyphs, digits that stand for letters), then matched with an Aho-Corasick
automaton; matches must begin a word, and matches inside an exception phrase don't count. The weights found, normalised
by the text's length, go through a logistic curve fitted on the same rows.

Scale: the lexicon is fitted on at most ``most_rows`` labelled rows, drawn by a hash of id and text, so the copies of a
text are thinned like all others. The draw is made on ids and hashes; only the drawn rows' texts are moved, by a
broadcast of their keys, which ``most_rows`` bounds. Terms are counted on the executors; at most ``most_terms`` come to
the driver, the ones that most toxic rows hold.

Defined cases: null and empty texts score as texts without matches; labels that are null, or neither 0 nor 1, teach
nothing; without rows of both labels nothing matches and every score is the share of toxic rows (0 without any);
repeated rows are scored each, and teach once if id, text and label are the same; an empty table gives an empty result;
further columns are kept, but for those with the names of the score and the flag, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textkit import released, text_column

#: Letters of other scripts, and digits and signs, that are written for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Phrases that hold a word of a lexicon without its sense.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bins", "class clown", "clown fish", "pathetic fallacy", "sore loser rule")

_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict.fromkeys(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)), ""))
_LETTERS = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    text = text.lower()
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    """Beginnings of words with weights, exception phrases, and the curve from weight to score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    bias: float = -30.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for x, w in self.weights.items():
            a.add_word(x, (len(x), w))
        for x in {*map(folded, self.exceptions)} if self.weights else ():
            a.add_word(x, (len(x), None) if x not in self.weights else (len(x), self.weights[x]))
        a.make_automaton()
        return a

    def strength(self, automaton, text: str) -> float:
        """The weights of the words that begin with an entry, the longest for each, by the root of the length in words."""
        if not self.weights:
            return 0.0
        text = folded(text)
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in automaton.iter(text):
            begin = end - n + 1
            if begin and text[begin - 1].isalpha():
                continue
            if w is None:
                if end + 1 == len(text) or not text[end + 1].isalpha():
                    spared.append((begin, end))
            elif begin not in found or found[begin][0] < n:
                found[begin] = (n, w)
        total = sum(w for x, (_, w) in found.items() if not any(a <= x <= b for a, b in spared))
        return total / (len(text) / 6 + 20) ** 0.5

    def score(self, strength: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.slope * strength, -60, 60))))


def _counts(shortest: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def counts() -> pa.RecordBatch:
            keys = list(seen[0] | seen[1])
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in seen]], ["term", "clean", "toxic"])
            for c in seen:
                c.clear()
            return out

        for batch in batches:
            for label, text in zip(batch.column("label"), batch.column("text"), strict=True):
                words = set(_LETTERS.findall(folded(text.as_py() or "")))
                own = seen[label.as_py()]
                own.update({w[:n] for w in words for n in range(shortest, min(longest, len(w)) + 1)})
                own[""] += 1
                if len(seen[0]) + len(seen[1]) > 100_000:  # a worker holds no more; the rest is summed after the shuffle
                    yield counts()
        yield counts()
        released()

    return run


def choose(terms: dict[str, tuple[int, int]], *, least: int, odds: float) -> dict[str, float]:
    """The weights of the beginnings to keep, from (clean, toxic) document counts; "" has all documents.

    A beginning counts if enough toxic documents hold it (more where there are more, up to 8) and its log odds are high. It gives way to a longer one that
    holds nearly all of its documents, and then stands for all words that begin with it.
    """
    clean, toxic = terms.get("", (0, 0))
    least = max(least, min(8, toxic // 40 + 2))
    weight = {t: np.log((b + 0.5) / (toxic + 1)) - np.log((a + 0.5) / (clean + 1)) for t, (a, b) in terms.items() if t and b >= least}
    weight = {t: min(float(w), 8.0) for t, w in weight.items() if w >= odds}
    longer: dict[str, list[str]] = {}
    for t in weight:
        longer.setdefault(t[:-1], []).append(t)
    out: dict[str, float] = {}
    for t in sorted(weight, key=lambda t: (len(t), t)):
        if any(t[:n] in out for n in range(1, len(t))):
            continue
        while on := [x for x in longer.get(t, ()) if terms[x][1] >= 0.9 * terms[t][1]]:
            t = min(on)
        out[t] = weight[t]
    return out


def _drawn(keys: DataFrame, most_rows: int) -> DataFrame:
    """id_, tie_ (a hash of the text), label of at most most_rows different rows: those with the smallest hashes of id and text."""
    keys = written(keys.distinct().withColumn("draw_", F.xxhash64("id_", "tie_", "label")), "keys")
    if keys.count() > most_rows:
        last = keys.select("draw_").orderBy("draw_").limit(most_rows).agg(F.max("draw_")).first()[0]
        keys = keys.where(F.col("draw_") <= last)
    return keys.drop("draw_")


def _texts_of(drawn: DataFrame, texts: DataFrame) -> DataFrame:
    """label, text of the drawn rows; drawn has most_rows rows at most, so it's broadcast whatever the texts are."""
    same = F.col("id_").eqNullSafe(F.col("of_")) & (F.col("tie_") == F.col("hash_"))
    own = texts.select(F.col("id_").alias("of_"), F.xxhash64("text").alias("hash_"), "text").join(F.broadcast(drawn), same)
    return written(own.groupBy("id_", "tie_", "label").agg(F.first("text").alias("text")).select("label", "text"), "sample")


def fit(rows: DataFrame, *, id_col: str = "doc_id", most_rows: int = 20_000, **options) -> Lexicon:
    """A lexicon from rows of text and label (0 or 1), and of an id if there is one; see learn() for the options."""
    own = rows.select((F.col(id_col) if id_col in rows.columns else F.lit(0)).cast("string").alias("id_"), F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1))
    return learn(_texts_of(_drawn(own.select("id_", F.xxhash64("text").alias("tie_"), "label"), most_rows), own.drop("label")), **options)


def learn(rows: DataFrame, *, least: int = 3, odds: float = 3.0, shortest: int = 3, longest: int = 12, most_terms: int = 50_000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from all rows of text and label (0 or 1).

    Beginnings of words have from shortest to longest letters. Those come to the driver that least toxic rows hold and
    whose log odds may reach odds; if they are more than most_terms, so many more toxic rows have to hold them that
    they aren't.
    """
    spark = rows.sparkSession
    counted = rows.mapInArrow(_counts(shortest, longest), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = written(counted, "terms")
    clean, toxic = next(((r["clean"], r["toxic"]) for r in counted.where("term = ''").collect()), (0, 0))
    ratio = float(np.exp(odds)) * (toxic + 1) / (clean + 1) * (1 - 1e-9)
    kept = counted.where((F.col("term") != "") & (F.col("toxic") >= least) & (F.col("toxic") + 0.5 >= ratio * (F.col("clean") + 0.5)))  # the rest can't have such odds
    so_far = 0
    for held_by, many in sorted(map(tuple, kept.groupBy("toxic").count().collect()), reverse=True):  # at most as many numbers as toxic rows
        so_far += many
        if so_far > most_terms:
            least = held_by + 1
            break
    terms = {r["term"]: (r["clean"], r["toxic"]) for r in kept.where(F.col("toxic") >= least).collect()} | {"": (clean, toxic)}
    lexicon = Lexicon(choose(terms, least=least, odds=odds) if clean and toxic else {}, exceptions)
    share = toxic / (clean + toxic) if clean + toxic else 0.0
    if not lexicon.weights:
        lexicon.slope, lexicon.bias = 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else (60.0 if share == 1 else -60.0)
        return lexicon
    held = spark.sparkContext.broadcast(lexicon)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value.automaton()
        for batch in batches:
            x = [held.value.strength(automaton, t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.round(x, 2), pa.float64())], ["label", "x"])

    seen = rows.mapInArrow(strengths, "label int, x double").groupBy("label", "x").count().collect()  # hundredths: a few hundred rows
    x, y, w = (np.array([float(r[i]) for r in seen]) for i in (1, 0, 2))
    lexicon.slope, lexicon.bias = _logistic(x, y, w)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept with a small ridge on the slope, by Newton steps."""
    design = np.stack((x, np.ones_like(x)))
    beta = np.array([0.0, 0.0])
    ridge = np.diag([0.5, 0.01])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        gradient = design @ (w * (y - p)) - ridge @ beta
        step = np.linalg.solve((design * (w * p * (1 - p) + 1e-9)) @ design.T + ridge, gradient)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.3, text_col: str = "text", score_col: str = "toxic_score", flag_col: str = "toxic_flag") -> DataFrame:
    """docs with a score from 0 to 1 and 1 where it's the threshold or more, else 0."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    docs = docs.drop(*{score_col, flag_col} - {text_col})
    names = docs.columns
    at = names.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value.automaton()
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = text_column(part.column(at)).to_pylist()
                x = np.array([held.value.score(held.value.strength(automaton, t)) for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(x, pa.float64()), pa.array((x >= threshold).astype("i4"))], [*names, score_col, flag_col])
        released()

    return docs.mapInArrow(run, f"{fields}, `{score_col}` double, `{flag_col}` int")


def held_out(c):
    """The fold that teaches nothing: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2


def fit_on(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000, **options) -> Lexicon:
    """A lexicon from the documents that labels (doc_id, toxic) covers, without the held-out fold."""
    own = labels.select(F.col("doc_id").cast("string").alias("id_"), F.col("toxic").cast("int").alias("label")).where(~held_out(F.col("id_")) & F.col("label").isin(0, 1))
    texts = docs.select(F.col("doc_id").cast("string").alias("id_"), F.col("text").cast("string").alias("text"))
    keys = texts.select("id_", F.xxhash64("text").alias("tie_")).join(own, "id_")
    return learn(_texts_of(_drawn(keys.select("id_", "tie_", "label"), most_rows), texts), **options)
