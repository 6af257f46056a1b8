"""Every query with SQL against DuckDB, and every other one for rows, on the smallest tables."""

import os

import duckdb
import pytest

from siltstone.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def clean(rows):
    fix = lambda v: "" if v is None else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return sorted(tuple(map(fix, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    want = con.sql(catalog.oracle_sql()[name])
    cols = sorted(want.columns)
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == cols
    assert clean(got.select(*cols).collect()) == clean(want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark):
    """Columns and filters reach the files."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = plan(catalog.queries()["rule_findings"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in found and "Exchange" not in found
    metrics = plan(catalog.queries()["line_metrics"](spark, SF))
    assert "Exchange" not in metrics and "Python" not in metrics
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in plan(catalog.queries()["prompt_intent"](spark, SF))
