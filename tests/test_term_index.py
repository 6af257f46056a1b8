"""The segmented index against one that is built anew, and what it writes."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators.search import TermIndex
from siltstone.operators.term_index import SegmentedIndex
from siltstone.session import scratch_path

SCHEMA = "doc_id long, text string"


@pytest.fixture
def index(spark):
    return SegmentedIndex.open(spark, scratch_path(spark, "segments"))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "green stones in the river"), (2, "paper lighthouse"), (3, "")], "item_id long, text string")


def hits(found):
    return sorted((r.query, r["rank"], r.id, round(r.score, 9)) for r in found.collect())


def same(spark, index, rows, queries):
    fresh = TermIndex.build(spark.createDataFrame(rows, SCHEMA))
    assert len(index) == len(rows)
    assert hits(index.search(queries, 3)) == hits(fresh.search(queries, 3))
    again = SegmentedIndex.open(spark, index.path)
    assert (len(again), again.segments) == (len(index), index.segments)


def test_every_change_equals_a_rebuild(spark, index, queries):
    rows = {1: "green river stones", 2: "a paper boat on the river", 3: "stones stones stones", 4: None, 5: "lighthouse of stone and paper"}
    df = lambda r: spark.createDataFrame(list(r.items()), SCHEMA)
    index.add(df({k: rows[k] for k in (1, 2)}))
    index.add(df({k: rows[k] for k in (3, 4, 5)}))
    same(spark, index, list(rows.items()), queries)
    rows |= {2: "nothing of the kind", 6: "green paper"}
    index.add(df({k: rows[k] for k in (2, 6)}))
    same(spark, index, list(rows.items()), queries)
    index.remove(spark.createDataFrame([(3,), (4,), (77,)], "id long"))
    rows = {k: v for k, v in rows.items() if k not in (3, 4)}
    same(spark, index, list(rows.items()), queries)
    index.add(df({3: "stones again"}))
    rows[3] = "stones again"
    same(spark, index, list(rows.items()), queries)
    assert len(index.segments) == 5
    index.compact()
    assert len(index.segments) == 1
    same(spark, index, list(rows.items()), queries)
    index.clear()
    assert len(index) == 0 and index.search(queries, 3).count() == 0
    index.add(df({9: "river"}))
    same(spark, index, [(9, "river")], queries)


def test_a_change_writes_only_what_it_changes(spark, index):
    index.add(spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word number "), F.col("id").cast("string")).alias("text")))
    first = set(spark.read.parquet(f"{index.path}/postings").inputFiles())
    index.add(spark.createDataFrame([(7, "another text")], SCHEMA))
    rows = spark.read.parquet(f"{index.path}/postings")
    assert first < set(rows.inputFiles())
    assert rows.filter(F.col("segment") == index.segments[-1]).select("id").distinct().collect() == [(7,)]
    index.remove(spark.createDataFrame([(8,)], "id long"))
    assert spark.read.parquet(f"{index.path}/postings").filter(F.col("segment") == index.segments[-1]).count() == 0


def test_rows_that_repeat_an_id(spark, index, queries):
    index.add(spark.createDataFrame([(1, "green"), (1, "green"), (None, "river")], SCHEMA))
    same(spark, index, [(1, "green")], queries)
