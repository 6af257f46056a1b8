"""The vector index against all pairs: exact searches equal them, others reach 0.9 of them."""

import os

import numpy as np
import pytest

from siltstone.operators import vector_index
from siltstone.operators.search import vector_search
from siltstone.operators.vector_index import VectorIndex, recall

SF = "/root/testdata/sf0.01"


def rows(found):
    return sorted((r.query, r["rank"], r.id, round(r.score, 9)) for r in found.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, a vector that a third of the rows has, and odd rows."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8))
    x = centers[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * 0.3
    x[::3] = x[0]
    out = [(i, [float(a) for a in v]) for i, v in enumerate(x.astype(np.float32))]
    out += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, 2.0]), (1004, [1.0, 2.5]), (1005, []), (1006, [-a for a in out[0][1]])]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize(("part", "block"), [(16_384, 16_384), (20, 7)])
def test_exact_search_equals_all_pairs(spark, vectors, monkeypatch, part, block):
    """Also where cells are dealt in small parts and queries in small blocks."""
    monkeypatch.setattr(vector_index, "PART", part)
    monkeypatch.setattr(vector_index, "BLOCK", block)
    index = VectorIndex.build(vectors, cells=10)
    queries = vectors.filter("vec_id % 7 = 0 OR vec_id > 1000")
    assert rows(index.search(queries, 5, probes=2, exact=True)) == rows(vector_search(vectors, queries, 5))


def test_the_nearest_cells_hold_the_neighbours_of_clustered_vectors(vectors):
    index = VectorIndex.build(vectors, cells=10)
    queries = vectors.filter("vec_id % 7 = 0")
    exact = vector_search(vectors, queries, 5)
    assert index.probes < 6 and recall(index.search(queries, 5), exact) > 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_on_the_table(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.filter("vec_id % 50 = 0")
    assert recall(VectorIndex.build(v).search(q, 10), vector_search(v, q, 10)) >= 0.9


def test_index_of_nothing(spark, vectors):
    index = VectorIndex.build(vectors.filter("false"))
    assert index.search(vectors, 3).count() == 0
    assert VectorIndex.build(vectors).search(vectors.filter("false"), 3, exact=True).count() == 0
