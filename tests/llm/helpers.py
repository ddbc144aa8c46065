"""Small documents with the awkward cases, and brute-force versions to compare with."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, place string, row string"


def awkward(spark, texts):
    """Documents with null ids and texts, repeated rows and columns named like inner ones."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "p", "r") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[0], None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None), (10_000, "", "xx", "s", 0, 1, "", "")]
    return spark.createDataFrame(rows, DOCS), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(seed: int, count: int, vocabulary: int = 5000) -> list[str]:
    random.seed(seed)
    return [f"w{random.randrange(vocabulary):x}" for _ in range(count)]


class Components:
    """Union-find on anything hashable; the smallest member names a component."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
