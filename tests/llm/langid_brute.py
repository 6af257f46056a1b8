"""Nearest centroids by plain loops: n-grams as strings, hashes of Python's own integers."""

import math
from collections import Counter, defaultdict
from itertools import groupby

from siltstone.llm.langid import DIM, QUANTILE, REJECT

M = 2**32


def grams(text):
    """Places of the 1-, 2- and 3-grams of a text; None if there is no letter."""
    words = ["".join(g) for letters, g in groupby((text or "").lower(), str.isalpha) if letters]
    if not words:
        return None
    t = [ord(c) for c in f" {' '.join(words)} "]
    one = lambda c: c * 0x9E3779B1 % M
    two = lambda a, b: (one(a) ^ one(b) >> 7) * 0x85EBCA6B % M
    three = lambda a, b, c: (two(a, b) ^ one(c) >> 5) * 0xC2B2AE35 % M
    found = [one(c) * 0x165667B1 % M for c in t]
    found += [two(*x) * 0x27D4EB2F % M for x in zip(t, t[1:], strict=False)]
    found += [three(*x) for x in zip(t, t[1:], t[2:], strict=False)]
    return Counter(x * DIM // M for x in found)


def idf(texts):
    counts = [g for g in map(grams, texts) if g]
    df = Counter(p for g in counts for p in g)
    return [math.log((1 + len(counts)) / (1 + df[p])) + 1 for p in range(DIM)]


def nearest(text, model, weights):
    """(language, cosine) of the nearest centroid; ('und', 0) for no letter."""
    g = grams(text)
    if not g:
        return "und", 0.0
    x = {p: math.log1p(k) * weights[p] for p, k in g.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    cos = [round(sum(v * model.centroids[p, j] for p, v in x.items()) / norm, 6) for j in range(len(model.owner))]
    best = cos.index(max(cos))
    return model.languages[model.owner[best]], cos[best]


def floors(rows, model, weights):
    """By language and length class: REJECT times the low quantile of the cosines of labelled rows, in steps of 1 / 256."""
    by = defaultdict(list)
    for text, lang in rows:
        g = grams(text)
        if g and lang:
            by[lang, int(math.log2(sum(g.values())))].append(min(255, math.floor(nearest(text, model, weights)[1] * 256)) / 256)
    return {k: REJECT * sorted(v)[max(0, math.ceil(QUANTILE * len(v)) - 1)] for k, v in by.items()}
