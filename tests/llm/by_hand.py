"""Operators once more, in plain Python, for tests."""

import hashlib
import math
import re

import numpy as np

from vellum.llm import toxicity

LETTERS = r"[^\W\d_]+"


def lexicon_by_hand(texts, labels):
    """Beginnings of words with their weights, from folded texts and labels by id."""
    holders = {}
    for i, t in texts.items():
        for w in set(re.findall(LETTERS, t)):
            for n in range(3, min(12, len(w)) + 1):
                holders.setdefault(w[:n], set()).add(i)
    toxic = sum(labels.values())
    clean = len(labels) - toxic
    least = max(3, min(8, toxic // 40 + 2))
    odds = {}
    for t, own in holders.items():
        b = sum(labels[i] for i in own)
        w = math.log((b + 0.5) / (toxic + 1)) - math.log((len(own) - b + 0.5) / (clean + 1))
        if b >= least and w >= 3.0:
            odds[t] = (min(w, 8.0), b)
    out = {}
    for t in sorted(odds, key=lambda t: (len(t), t)):
        if not any(t.startswith(x) and x != t for x in out):
            while on := sorted(x for x in odds if len(x) == len(t) + 1 and x.startswith(t) and odds[x][1] >= 0.9 * odds[t][1]):
                t = on[0]
            out[t] = odds[t][0]
    return out


def strength_by_hand(t, weights, exceptions=toxicity.EXCEPTIONS):
    """Of a folded text: the weights of its words, the longest beginning of each, by the root of the length."""
    spared = [(m.start(), m.end()) for e in exceptions for m in re.finditer(rf"(?<![^\W\d_]){re.escape(e)}(?![^\W\d_])", t)]
    total = 0.0
    for m in re.finditer(LETTERS, t):
        own = [m[0][:n] for n in range(1, len(m[0]) + 1) if m[0][:n] in weights]
        if own and not any(a <= m.start() < b for a, b in spared):
            total += weights[max(own, key=len)]
    return total / (len(t) / 6 + 20) ** 0.5


def score_by_hand(strength, lexicon):
    return 1 / (1 + np.exp(-(lexicon.bias + lexicon.slope * strength)))


def copies_by_hand(rows, weights=(5, 2, 1), share=1.5, cap=2):
    """How often a mix takes each row (doc_id, source, size): passes by virtual finish time, cut at the budget."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, own, n in rows if own == s) for s in sources}
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(sources)}
    budget, target, left = share * sum(size.values()), {}, list(sources)
    while left:  # those above their cap stop there, the rest is dealt out again
        rest = budget - sum(target.values())
        level = rest / sum(w[s] for s in left)
        over = [s for s in left if w[s] * level >= cap * size[s]]
        if not over:
            target |= {s: w[s] * level for s in left}
            break
        target |= {s: float(cap * size[s]) for s in over}
        left = [s for s in left if s not in over]
    entries = []
    for s in sources:
        key = lambda r: hashlib.md5(f"{'null' if r[0] is None else r[0]}:42".encode()).hexdigest()[:15]
        so_far = 0
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (key(r), r[0] or 0, r[2])):
            so_far += r[2]
            for p in range(cap):
                finish = (p * size[s] + so_far) / target[s] if target[s] else 0.0
                entries.append((finish, p, s is None, s or "", key(r), r[0] or 0, r[2], r))
    out, total = {r: 0 for r in rows}, 0
    for *_, n, r in sorted(entries, key=lambda e: e[:7]):
        total += n
        if total <= budget and n:
            out[r] += 1
    return {r: k if r[2] else 1 for r, k in out.items()}
