"""Large packs of literal rules against plain loops and against the unrolled plan."""

import random

import pytest

from siltstone.operators import matching
from siltstone.operators.rules import Rule, findings


@pytest.fixture(scope="module")
def case():
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("ab é日\n") for _ in range(n))
    texts = [(i, some(rng.randint(0, 60))) for i in range(80)] + [(90, None), (91, ""), (92, "ab" * 30000 + "\nzz日z"), (93, "aaaa"), (93, "aaaa")]
    needles = sorted({some(rng.randint(1, 6)) for _ in range(150)} | {"a", "é", "日", "aa", "zz日z", "aaa", "not there at all"})
    return texts, [(f"R{i}", n) for i, n in enumerate(needles)] + [("twin", "a"), ("none", None)]


def brute(texts, rules):
    return sorted((i, r, t.count(n), t.count("\n", 0, t.find(n)) + 1) for i, t in texts for r, n in rules if n and t and n in t)


@pytest.mark.parametrize("pack_bytes", [1 << 20, 0])
def test_against_loops(spark, case, monkeypatch, pack_bytes):
    monkeypatch.setattr(matching, "PIECE", 50)
    texts, rules = case
    df = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, gram string, k0 int").repartition(3)
    pack = spark.createDataFrame(rules, "rule_id string, needle string")
    out = matching.literal_findings(df, pack, ["doc_id"], pack_bytes=pack_bytes)
    assert sorted(map(tuple, out.collect())) == brute(texts, rules)


def test_joined_pack_meets_blocks(spark, case, monkeypatch):
    """Texts are not repeated for each rule that might be in them, also when blocks are short and the pack has many parts."""
    monkeypatch.setattr(matching, "BLOCK", 100, raising=False)
    monkeypatch.setattr(matching, "PACK_BYTES", 2000)
    texts, rules = case
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    out = matching.literal_findings(df, spark.createDataFrame(rules, "rule_id string, needle string"), ["doc_id"], pack_bytes=0)
    assert sorted(map(tuple, out.collect())) == brute(texts, rules)
    assert "Contains(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_same_findings_as_the_unrolled_plan(spark, case):
    texts, rules = case
    df = spark.createDataFrame(texts, "doc_id long, text string").filter("doc_id <> 93")
    plain = [(r, n) for r, n in rules if n and "\n" not in n and n.strip()][:30]
    unrolled = findings(df, [Rule(r, f"text:{n}") for r, n in plain], ["doc_id"])
    out = matching.literal_findings(df, spark.createDataFrame(plain, "rule_id string, needle string"), ["doc_id"])
    key = lambda d: sorted(map(tuple, d.select("doc_id", "rule_id", "count", "line").collect()))
    assert key(out) == key(unrolled)


def test_plan_does_not_grow_with_the_pack(spark, case):
    df = spark.createDataFrame(case[0], "doc_id long, text string")

    def size(n):
        pack = spark.createDataFrame([(i, f"needle {i}") for i in range(n)], "rule_id int, needle string")
        return len(matching.literal_findings(df, pack, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString())

    assert size(5) == pytest.approx(size(3000), abs=50)


def test_empty_needles_are_refused(spark):
    with pytest.raises(ValueError, match="everywhere"):
        matching.literal_findings(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("r", "")], "rule_id string, needle string"), ["doc_id"])


def test_texts_without_hits_beside_others(spark, monkeypatch):
    """Blocks of no hit, needles over the ends of pieces and texts, and long needles."""
    monkeypatch.setattr(matching, "PIECE", 8)
    long = "needle " * 9
    texts = [(1, "q" * 40), (2, long + "need"), (3, "le needle"), (4, ""), (5, "x\n" * 9 + long + long)]
    rules = [("a", long), ("b", "needle"), ("c", "eneedle"), ("d", "dlen"), ("e", "e n")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    out = matching.literal_findings(df, spark.createDataFrame(rules, "rule_id string, needle string"), ["doc_id"])
    assert sorted(map(tuple, out.collect())) == brute(texts, rules)


def test_nothing(spark, case):
    df = spark.createDataFrame(case[0], "doc_id long, text string")
    pack = spark.createDataFrame(case[1], "rule_id string, needle string")
    assert matching.literal_findings(df.filter("false"), pack, ["doc_id"]).count() == 0
    assert matching.literal_findings(df, pack.filter("false"), ["doc_id"]).count() == 0
