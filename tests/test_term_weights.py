"""Lengths and products from stems, and what a segment takes on disk."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from siltstone.functions.text import terms_with_bigrams
from siltstone.operators import search, term_weights, terms
from siltstone.operators.term_index import SegmentedIndex
from siltstone.session import scratch_path


def words(rng, n):
    return " ".join(rng.choice(("green", "river", "stones", "paper", "the")) if rng.random() < 0.2 else f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randrange(1, 60))) for i in range(120)] + [(500, ""), (501, None), (502, "the")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_packed():
    for x in (np.array([], np.uint32), np.array([1, 7, 1 << 31], np.uint32), np.arange(999, dtype=np.uint64) ** 6):
        assert (term_weights.unpacked(term_weights.packed(x), len(x), x.dtype.type) == x).all()


@pytest.mark.parametrize(("piece", "added", "queried"), [(4 << 20, 1 << 22, 1 << 20), (200, 3, 1 << 20), (200, 3, 0)])
def test_search_equals_a_loop(spark, docs, monkeypatch, piece, added, queried):
    for where, name, value in ((terms, "PIECE", piece), (term_weights, "ADDED", added), (term_weights, "BUCKET", 100), (search, "QUERIED", queried)):
        monkeypatch.setattr(where, name, value)
    queries = spark.createDataFrame([("a", "green stones in the river"), ("b", "paper w1 w2 w3"), ("c", ""), ("d", "unknown")], "item_id string, text string")
    count = lambda df: {r[0]: Counter(r[1]) for r in df.select(df.columns[0], terms_with_bigrams(df.text)).collect()}
    d, q = count(docs), count(queries)
    df = Counter(t for c in d.values() for t in c)
    w = {i: {t: n / c.total() * math.log(len(d) / df[t]) for t, n in c.items()} for i, c in d.items()}
    want = {}
    for k, c in q.items():
        for i, own in w.items():
            dot = sum(own.get(t, 0) * n / c.total() for t, n in c.items())
            if dot > 0:
                want[k, i] = dot / math.sqrt(sum(x * x for x in own.values())) / math.sqrt(sum((n / c.total()) ** 2 for n in c.values()))
    found = {(r.query, r.id): r.score for r in search.tfidf_search(docs, queries, 1000).collect()}
    assert len(want) > 50 and found == pytest.approx(want)


def test_a_segment_is_smaller_than_its_texts(spark, docs):
    """Stems are written, not a hash and a share for each term of them."""
    rng = random.Random(12)
    rows = spark.createDataFrame([(i, words(rng, 400)) for i in range(300)], "doc_id long, text string").coalesce(1)
    index = SegmentedIndex.open(spark, scratch_path(spark, "segments")).add(rows)
    folder = f"{index.path}/postings".removeprefix("file://")
    size = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    assert size < sum(len(r.text) for r in rows.collect())
