"""The registered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__



def key(r):
    return tuple(("" if v is None else str(v)) for v in r)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 11, 12, 13])
def test_against_sql(spark, entry, n):
    name = next(q for q in entry.queries() if q.startswith(f"op{n}_"))
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    got = entry.queries()[name](spark, SF)
    assert cols == sorted(got.columns)
    clean = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(clean, got.select(*cols).collect()), key=key) == sorted(map(clean, want.select(*[f'"{c}"' for c in cols]).fetchall()), key=key)


def test_all_operators_are_registered(entry):
    names = [q.split("_")[0] for q in entry.queries() if q.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert out.columns == columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        counts.append(docs.count())
    assert counts[1] >= 0.99 * counts[0] and counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    assert docs.filter("n_tokens <> size(token_ids)").count() == 0
    ids = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert ids(corpus_pipeline.run(spark, SF)) == ids(docs)
