"""Katz back-off by the book, over whole dictionaries, of any order."""

import math
import zlib
from collections import Counter, defaultdict

from siltstone.llm.katz import K, discounts

BEGIN = "<begin>"


class Brute:
    def __init__(self, texts, order):
        """texts: lists of tokens, with the end."""
        self.order, self.c, self.ch = order, defaultdict(Counter), defaultdict(Counter)
        for t in texts:
            for n in range(1, order + 1):
                padded = [*[BEGIN] * (n - 1), *t]
                for i in range(len(t)):
                    h, w = tuple(padded[i : i + n - 1]), padded[i + n - 1]
                    self.c[n][h, w] += 1
                    self.ch[n][h] += 1
        self.n = sum(self.c[1].values())
        self.d = {n: discounts([sum(v == r for v in self.c[n].values()) for r in range(1, K + 2)]) for n in range(1, order + 1)}
        self.after = {n: defaultdict(list) for n in range(1, order + 1)}
        for n in range(1, order + 1):
            for (h, w), c in self.c[n].items():
                self.after[n][h].append((w, c))
        self.kept = {}

    def total(self, n, h):
        """The history's count, one more where no count after it is discounted."""
        return self.ch[n][h] + all(c > K for _, c in self.after[n][h])

    def seen(self, n, h, w):
        c = self.c[n][h, w]
        return (self.d[n][c - 1] if c <= K else 1.0) * c / self.total(n, h)

    def weight(self, n, h):
        if (n, h) not in self.kept:
            words = [w for w, _ in self.after[n].get(h, ())]
            left = 1 - sum(self.seen(n, h, w) for w in words)
            self.kept[n, h] = left / (1 - sum(self.p(n - 1, h[1:], w) for w in words)) if words else 1.0
        return self.kept[n, h]

    def p(self, n, h, w):
        if self.c[n][h, w]:
            return self.seen(n, h, w)
        if n == 1:
            return 1 - sum(self.seen(1, (), w) for w, _ in self.after[1][()]) if self.n else 1.0
        return self.weight(n, h) * self.p(n - 1, h[1:], w)

    def score(self, t):
        k = self.order - 1
        padded = [*[BEGIN] * k, *t]
        return sum(math.log10(self.p(self.order, tuple(padded[i : i + k]), padded[i + k])) for i in range(len(t)))

    def base(self, t):
        return sum(math.log10((self.c[1][(), w] + 1) / (self.n + len(self.c[1]) + 1)) for w in t)


def tokens(text):
    return [*(text or "").encode().lower().split(), "<end>"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
