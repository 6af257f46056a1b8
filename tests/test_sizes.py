"""What plans do with tables that are larger than they look: nothing that was exploded is broadcast, rows meet no more often than they must."""

import os
import random
from functools import reduce

import pyarrow as pa
import pytest

from siltstone.operators import dedup, drift, graph, prefixes, state
from siltstone.plans import catalog
from siltstone.sources import files

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_ranges_meet_once(spark):
    deps = spark.createDataFrame([(i, "e", "p", f"{i % 3}.{i % 5}") for i in range(60)] + [(60, "e", None, "1"), (61, "e", "p", None)], "id int, ecosystem string, package string, version string")
    v = spark.createDataFrame([("e", "p", f"{i % 3}.1", f"{i % 3}.3", i, "low") for i in range(30)], "ecosystem string, package string, min_version string, max_version string, advisory int, severity string")
    want = {i: (10, i % 3) for i in range(60) if 1 <= i % 5 <= 3}
    out = files.advised(deps, v)
    assert {r.id: (r.advisories, r.first_advisory) for r in out.collect()} == want
    assert "Broadcast" not in plan(out)


@tables
def test_versions_are_not_broadcast(spark):
    """A version asks at each level of bins: its rows are many more than the file's size tells."""
    assert "Broadcast" not in plan(catalog.queries()["vuln_range_join"](spark, SF))


def test_drift_adds_in_the_order_of_weights(spark):
    """Scores on the border of an alert do not depend on the order in which rows arrive."""
    rng = random.Random(5)
    deltas = {f: {m: -rng.randrange(4, 40) / 60 for m in drift.WEIGHTS} for f in range(60)}
    rows = [(f, m, x, "declining", "low", 3) for f, each in deltas.items() for m, x in reversed(each.items())]
    trend = spark.createDataFrame(rows, "f int, metric string, delta double, direction string, severity string, n long").coalesce(1)
    want = {f: min(1.0, reduce(float.__add__, (-x * drift.WEIGHTS[m] for m, x in each.items()))) for f, each in deltas.items()}
    assert {r.f: r.score for r in drift.drift_score(trend, ["f"]).collect()} == want


def test_pairs_that_cannot_be_alike_get_no_words(spark):
    """All sets share the rarest words of their prefixes, and few of the others; only pairs that are alike are given their words."""
    own = lambda i, n: [f"w{i}x{k}" for k in range(n)]
    texts = {i: [*own(0, 3), *own(i // 2 + 1, 36), f"own{i}"] for i in range(40)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id int, text string").repartition(2)
    out = dedup.near_pairs(docs, "doc_id", "text", 0.85)
    assert sorted((r.a, r.b) for r in out.collect()) == [(i, i + 1) for i in range(0, 40, 2)]
    met = next(p for p in out.inputFiles() if "/met-" in p).rsplit("/", 1)[0]
    assert spark.read.parquet(met).count() == 20


def test_globs_meet_the_paths_that_begin_as_they_do(spark):
    """Very many globs in one folder: a path is matched with those alone whose beginning it has."""
    v = spark.createDataFrame([("R", f"u/f{i}") for i in range(40)] + [("R", None), ("S", "u/f1")], "rule_id string, path string")
    e = spark.createDataFrame([(i, "R", "glob", f"u/f{i}*", i) for i in range(100)] + [(-1, "R", "glob", "*/f2?", 999), (-2, "R", "glob", "u/f3", -1)], "id int, rule_id string, scope_kind string, scope_value string, ordinal int")
    out = state.exempted(v, e)
    want = {f"u/f{i}": -2 if i == 3 else i if i < 10 else i // 10 for i in range(40)}
    assert {r.path: r.exemption for r in out.filter("rule_id = 'R' AND path IS NOT NULL").collect()} == want
    assert [r.exemption for r in out.filter("rule_id = 'S' OR path IS NULL").collect()] == [None, None]
    filed = next(p for p in out.inputFiles() if "/exemptions-" in p).rsplit("/", 1)[0]
    assert spark.read.parquet(filed).filter("_of = 'g:u/f3'").count() == 1


def test_rounds_of_a_search_are_not_broadcast(spark):
    """Neither a frontier nor the edges nor what was seen goes through the driver, however small their files are."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    edges = spark.range(60).selectExpr("id AS src", "id div 2 AS dst").filter("src > 0")
    found = graph.impact(edges, spark.range(3).selectExpr("id AS node"))
    assert {r.node: r.affected for r in found.collect()} == {0: 59, 1: 58, 2: 30}
    done = store.executionsList()
    plans = [done.apply(i).physicalPlanDescription() for i in range(before, done.size())]
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)


def test_sets_are_sorted_in_pieces(monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 8)
    sets = [[1, 2, 3], [], [4] * 20, [5], [6, 7], [], [8, 9, 10, 11]]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "h"])
    got = [x.to_pydict() for x in prefixes.pieces(b)]
    assert [i for x in got for i in x["id"]] == list(range(7)) and [h for x in got for h in x["h"]] == sets
    assert len(got) > 1 and all(sum(map(len, x["h"][:-1])) <= 8 for x in got)


@tables
def test_sources_of_a_small_file_are_dealt_to_tasks(spark, monkeypatch):
    """Sources are made of short rows: one file of them is not one task's."""
    from siltstone.plans import pack_queries

    monkeypatch.setattr(pack_queries, "ROWS", 50, raising=False)
    assert pack_queries.sources(spark, SF).rdd.getNumPartitions() > 2


def test_brackets_against_a_loop(spark):
    from siltstone.operators import lines

    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("([{)]}a") for _ in range(rng.randint(0, 9)))) for i in range(200)] + [(200, None)]

    def brute(text):
        depth, early = dict.fromkeys("([{", 0), False
        for c in text or "":
            if c != "a":
                depth["([{"["([{)]}".index(c) % 3]] += 1 if c in "([{" else -1
                early |= min(depth.values()) < 0
        return sum(depth.values()), early, any(depth.values())

    out = lines.balance(spark.createDataFrame(texts, "i int, text string"), ["i"])
    assert {r.i: (r.unclosed, r.early_close, r.unbalanced) for r in out.collect()} == {i: brute(t) for i, t in texts}
