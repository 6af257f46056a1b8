"""Terms that are counted inside their row against the columns that they stand for."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import terms_with_bigrams
from siltstone.operators import search, terms
from siltstone.operators.term_index import SegmentedIndex
from siltstone.plans import catalog
from siltstone.session import scratch_path

TEXTS = [None, "", "the of and", "a b c", "x", "Running TESTS of nationalizations", "été É ﬁn x1 x1 the x1", "ab ab ab ab", "ab9 ab ab0 ab", "\u4e2d \u4e2dings \u00e9\u00e9s ed ing 1ing", "green_stones\tgreen-stones\n", "İstanbul ΟΔΟΣ ß \U0001d7d8 \U00010400ers"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(2)


@pytest.fixture
def expected(docs):
    rows = docs.select("doc_id", terms_with_bigrams(F.col("text")).alias("t")).collect()
    return {r.doc_id: r.t for r in rows}


@pytest.mark.parametrize("piece", [1, 30, 4 << 20])
def test_terms_are_those_of_the_columns(docs, expected, monkeypatch, piece):
    monkeypatch.setattr(terms, "PIECE", piece)
    want = {(i, t): (ts.count(t), ts.count(t) / len(ts)) for i, ts in expected.items() for t in ts}
    assert {(r.id, r.term): (r.n, r.tf) for r in terms.term_table(docs, "doc_id", "text").collect()} == want
    want = {i: (len(ts), len(set(ts)), min(ts, key=str.encode), max(ts, key=str.encode)) for i, ts in expected.items() if ts}
    assert {r.id: tuple(r)[1:] for r in terms.term_counts(docs, "doc_id", "text").collect()} == want
    want = [t for ts in expected.values() for t in set(ts)]
    assert {r.term: r.df for r in terms.frequencies(docs, "text").collect()} == {t: want.count(t) for t in want}
    vectors = {r.id: r for r in terms.term_vectors(docs, "doc_id", "text").collect()}
    assert {i: v.size for i, v in vectors.items()} == {i: len(set(ts)) for i, ts in expected.items()}
    assert len({t for v in vectors.values() for t in v.terms}) == len(set(want))


def test_terms_are_not_shuffled(docs):
    for df in (terms.term_table(docs, "doc_id", "text"), terms.term_counts(docs, "doc_id", "text"), terms.hashed_terms(docs, "doc_id", "text")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan


def test_rows_that_repeat_a_document(spark, tmp_path):
    rows = [(1, "green stones"), (1, "green stones"), (2, "green river")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.terms, r.different) for r in catalog.queries()["tokenize_terms"](spark, str(tmp_path)).collect()}
    assert got == {1: (6, 3), 2: (3, 3)}
    assert {r.term: r.df for r in catalog.queries()["idf_table"](spark, str(tmp_path)).collect()}["green"] == 2


def test_a_document_is_a_row_of_a_segment(spark):
    """What finds the live documents moves a row for each, not one for each of their terms; what ended as a whole is not read."""
    index = SegmentedIndex.open(spark, scratch_path(spark, "segments"))
    rows = spark.createDataFrame([(i, f"green stones number {i}") for i in range(20)], "doc_id long, text string")
    index.add(rows)
    assert spark.read.parquet(f"{index.path}/postings").count() == 20
    index.add(rows.withColumn("text", F.lit("paper")))
    plan = index.vectors()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and index.vectors().count() == 20
    index.remove(rows.filter("doc_id < 5").select(F.col("doc_id").alias("id")))
    assert sorted(r.id for r in index.vectors().collect()) == list(range(5, 20))


def test_a_search_weighs_postings_without_saving_them(spark, docs):
    """The rows of a saved index, from the documents' vectors alone."""
    queries = spark.createDataFrame([(1, "ab x1 running"), (2, "stones")], "item_id int, text string")
    found = search.tfidf_search(docs, queries, 3)
    assert not any("/index-postings-" in p or "/index-terms-" in p for p in found.inputFiles())
    rows = lambda df: sorted((r.query, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert rows(found) == rows(search.TermIndex.build(docs).search(queries, 3))
