"""Queries do the whole job: results worked out apart from the registered SQL."""

import os
from collections import defaultdict

import pytest

from siltstone.operators import graph, insight
from siltstone.plans import catalog

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def read(spark, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]


@tables
def test_question_effects_counts_all_events(spark):
    weight = {"click": 0.1, "view": 0.2, "purchase": 0.3}
    total, white = defaultdict(float), defaultdict(bool)
    for user, kind in read(spark, "events", "user_id", "event_type"):
        total[user] += weight.get(kind, 0.0)
        white[user] |= kind == "purchase"
    got = {r.user_id: (r.boost, r.uncapped, r.whitelisted) for r in catalog.queries()["question_effects"](spark, SF).collect()}
    assert got == {u: (round(min(1.0, t), 6), round(t, 6), white[u]) for u, t in total.items()}


def test_chains_of_trust_of_any_length(spark):
    rows = [(0, None, True)] + [(i, i - 1, True) for i in range(1, 100)]
    rows += [(200, 99, False), (201, 200, True), (300, 301, True), (301, 300, True), (302, 301, True), (400, 999, True)]
    c = spark.createDataFrame(rows, "id long, parent long, valid boolean")
    got = {r.id for r in insight.chain_trust(c, c.filter("id = 0").select("id")).collect() if r.trusted}
    assert got == set(range(100))


def test_impact_has_no_depth_limit(spark):
    e = spark.createDataFrame([(i, i - 1) for i in range(1, 14)] + [(0, 13)], "src long, dst long")
    got = graph.impact(e, spark.createDataFrame([(0,), (5,)], "node long")).collect()
    assert {(r.node, r.affected, r.risk) for r in got} == {(0, 13, "high"), (5, 13, "high")}


def test_latest_of_long_chains_and_circles(spark):
    links = spark.range(5000).selectExpr("id AS old", "id + 1 AS new")
    links = links.union(spark.createDataFrame([(-1, -2), (-2, -1), (-3, -1)], "old long, new long"))
    got = {r.id: (r.latest, r.steps) for r in graph.supersedes(links).collect()}
    assert got == {i: (5000, 5000 - i) for i in range(5000)} | {-1: (None, None), -2: (None, None), -3: (None, None)}


def test_decision_latest_keeps_conversations_apart(spark, tmp_path):
    rows = [(1, 0), (1, 99999), (1, 100000), (1, 100001), (2, 0), (2, 1), (2, 2)]
    spark.createDataFrame(rows, "conv_id long, turn long").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in catalog.queries()["decision_latest"](spark, str(tmp_path)).select("id", "latest", "steps").collect())
    assert got == [(100000, 200001, 3), (199999, 200001, 2), (200000, 200001, 1), (200000, 200002, 2), (200001, 200002, 1)]


@tables
def test_every_part_is_a_call(spark):
    parts = read(spark, "part", "p_partkey", "p_name", "p_size")
    named, full = defaultdict(set), defaultdict(set)
    for key, name, size in parts:
        named[name].add(key)
        full[name, size].add(key)
    got = {r.src: r.targets for r in catalog.queries()["call_resolution"](spark, SF).collect()}
    assert got == {key: len(named[name] if size % 2 else full[name, size]) for key, name, size in parts}


def test_chains_and_cycles_of_any_length(spark):
    e = spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)] + [(20, 0), (8, 30)], "src long, dst long")
    got = graph.chains(e, spark.createDataFrame([(20,)], "node long"), spark.createDataFrame([(30,), (5,)], "node long")).collect()
    assert {(r.start, r.goal): r.path for r in got} == {(20, 30): [20, *range(9), 30], (20, 5): [20, *range(6)]}
    assert [r.path for r in graph.cycles(e).collect()] == [list(range(9))]


@pytest.mark.parametrize("sent", [0, 2, 1 << 18])
def test_chains_with_frontiers_that_are_sent_or_shuffled(spark, monkeypatch, sent):
    monkeypatch.setattr(graph, "_SENT", sent)
    rows = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 6), (7, 3), (7, 1), (8, 9)]
    e = spark.createDataFrame(rows, "src long, dst long")
    got = graph.chains(e, spark.createDataFrame([(1,), (7,), (8,)], "node long"), spark.createDataFrame([(6,), (2,), (7,)], "node long")).collect()
    assert {(r.start, r.goal): r.path for r in got} == {(1, 6): [1, 2, 4, 5, 6], (7, 6): [7, 3, 4, 5, 6], (1, 2): [1, 2], (7, 2): [7, 1, 2]}


@tables
def test_call_chain_reaches_node_1_from_every_start(spark):
    starts = {key for key, _ in read(spark, "part", "p_partkey", "p_size") if key % 50 == 0 and key > 1}
    got = catalog.queries()["call_chain"](spark, SF).filter("goal = 1").collect()
    assert {r.start for r in got} == starts
