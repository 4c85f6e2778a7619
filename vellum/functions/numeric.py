"""Losses, similarities and schedules as columns over arrays of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it's used, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_sum_exp(a: Column) -> Column:
    return bound(a, lambda v: bound(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))))


def softmax(a: Column) -> Column:
    return bound(a, lambda v: bound(log_sum_exp(v), lambda whole: F.transform(v, lambda x: F.exp(x - whole))))


def log_softmax(a: Column) -> Column:
    return bound(a, lambda v: bound(log_sum_exp(v), lambda whole: F.transform(v, lambda x: x - whole)))


def scaled(a: Column, temperature: float) -> Column:
    return F.transform(a, lambda x: x / F.lit(temperature))


def cross_entropy(logits: Column, label: Column) -> Column:
    """label from 0."""
    return log_sum_exp(logits) - F.get(logits, label)


def focal(logits: Column, label: Column, gamma: float = 2.0) -> Column:
    ce = cross_entropy(logits, label)
    return F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce


def rank_margin(positive: Column, negative: Column, beta: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), F.lit(beta) - positive + negative)


def similarity_margin(log_p: Column, similarity: Column, label: Column, wrong: Column, beta: float = 0.1) -> Column:
    """How far a wrong token comes up to the right one, beyond beta times the difference of their similarities; never below 0."""
    at = lambda a, i: F.get(a, i)
    return F.greatest(F.lit(0.0), F.lit(beta) * (at(similarity, label) - at(similarity, wrong)) - at(log_p, label) + at(log_p, wrong))


def token_similarity(probabilities: Column, embeddings: Column) -> Column:
    """For each token: its embedding's product with the expected embedding, and the probability of token 0, halved."""
    weighted = F.zip_with(embeddings, probabilities, lambda e, p: F.transform(e, lambda x: x * p))
    expected = F.aggregate(F.slice(weighted, 2, F.size(weighted)), F.get(weighted, F.lit(0)), lambda s, e: F.zip_with(s, e, lambda x, y: x + y))
    return bound(expected, lambda x: F.transform(embeddings, lambda e: (dot(e, x) + F.get(probabilities, F.lit(0))) / 2))


def clamped_label(label: Column, classes: Column) -> Column:
    return F.least(F.greatest(label, F.lit(0)), classes - 1)


def combined_loss(rank: Column, margin: Column, kl: Column, focal_loss: Column, weight: float = 0.01) -> Column:
    """Ranking and margin, and a little of the divergence and the focal loss."""
    return rank + margin + F.lit(weight) * (kl + focal_loss)


def contrast(a: Column, b: Column, temperature: float = 0.2) -> Column:
    """The mean over the vectors of a of the cross entropy of their cosines with b's vectors, their own partner being the label."""
    each = F.transform(a, lambda x, i: cross_entropy(F.transform(b, lambda y: cosine(x, y) / F.lit(temperature)), i))
    return total(each) / F.size(a)


def smoothed(logits: Column, label: Column, eps: float = 0.1) -> Column:
    """Cross entropy against 1 - eps on the label and eps shared by the others."""
    n, rest = F.size(logits), log_sum_exp(logits)
    log_p = F.get(logits, label) - rest
    others = total(logits) - n * rest - log_p
    return -(F.lit(1 - eps) * log_p + F.lit(eps) / (n - 1) * others)


def kl_one_hot(logits: Column, label: Column) -> Column:
    """Of a one-hot distribution from the predicted one: minus the label's log probability."""
    return cross_entropy(logits, label)


def length_normalised(score: Column, length: Column, alpha: float) -> Column:
    return score / F.pow(length.cast("double"), F.lit(alpha))


def highest_wrong(logits: Column, label: Column) -> Column:
    return F.array_max(F.filter(logits, lambda x, i: i != label))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of them has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def attention(query: Column, frames: Column) -> Column:
    """Frames weighted by the softmax of their products with the query, summed."""
    weights = softmax(F.transform(frames, lambda f: dot(f, query)))
    weighted = F.zip_with(frames, weights, lambda f, w: F.transform(f, lambda x: x * w))
    return F.aggregate(F.slice(weighted, 2, F.size(weighted)), F.get(weighted, F.lit(0)), lambda s, f: F.zip_with(s, f, lambda x, y: x + y))


def pooled(frames: Column, bins: int) -> Column:
    """Means of ``bins`` stretches of frames: from floor(i * n / bins) up to ceil((i + 1) * n / bins)."""
    n = F.size(frames)

    def mean(i: Column) -> Column:
        lo, hi = F.floor(i * n / bins).cast("int"), F.ceil((i + 1) * n / bins).cast("int")
        part = F.slice(frames, lo + 1, hi - lo)
        sums = F.aggregate(F.slice(part, 2, F.size(part)), F.get(part, F.lit(0)), lambda s, f: F.zip_with(s, f, lambda x, y: x + y))
        return F.transform(sums, lambda x: x / (hi - lo))

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), mean)


def step_decay(step: Column, base: float, size: int, gamma: float = 0.1) -> Column:
    return F.lit(base) * F.pow(F.lit(gamma), F.floor(step / size))


def linear_warmup(step: Column, base: float, warmup: int, steps: int) -> Column:
    return F.lit(base) * F.when(step < warmup, step / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), (steps - step) / max(1, steps - warmup)))


def cosine_warmup(step: Column, base: float, warmup: int, steps: int) -> Column:
    done = (step - warmup) / max(1, steps - warmup)
    return F.lit(base) * F.when(step < warmup, step / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * done))))


def cosine_restarts(step: Column, base: float, first: int) -> Column:
    """Periods double: the k-th begins at first * (2**k - 1)."""
    k = F.floor(F.log2(step / first + 1) + 1e-12)
    period = F.lit(first) * F.pow(F.lit(2.0), k)
    at = step - F.lit(first) * (F.pow(F.lit(2.0), k) - 1)
    return F.lit(base) * 0.5 * (1 + F.cos(F.lit(math.pi) * at / period))
