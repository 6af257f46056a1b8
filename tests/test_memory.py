"""Memory, imports, contracts, the term index, signatures and streams with an end, on small frames."""

import hashlib
import hmac
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import certify, memory, search
from siltstone.streaming import stateful, windows


@pytest.mark.parametrize(("word", "stem"), [("organization", "organize"), ("relational", "relate"), ("hopefulness", "hopeful"), ("nations", "nation"), ("references", "reference"), ("payments", "payment"), ("cities", "citi"), ("qualities", "quality"), ("buildings", "building"), ("natives", "native"), ("realized", "realize"), ("useful", "use"), ("famous", "fam"), ("native", "nat"), ("running", "runn"), ("walked", "walk"), ("boxes", "box"), ("quickly", "quick"), ("reader", "read"), ("cats", "cat"), ("is", "is"), ("gas", "gas"), ("été", "été"), ("élus", "élu")])
def test_stems(spark, word, stem):
    """Worked by hand from the order of the suffixes."""
    assert spark.createDataFrame([(word,)], "t string").select(tx.stem(F.col("t"))).first()[0] == stem


def test_stop_words_go_after_stemming(spark):
    got = spark.createDataFrame([("These dogs were the others, and ITS new ways during a walk",)], "t string").select(tx.stems(F.col("t"))).first()[0]
    assert got == ["dog", "way", "dur", "walk"]


def entries(spark):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, "fix" if i % 2 else "note", f"p{i % 3}", i * 7 % 5, t + timedelta(days=i * 3 % 7)) for i in range(10)], "id long, memory_type string, project string, recall_count long, created_at timestamp")


def test_recall(spark):
    e = entries(spark)
    assert [r.id for r in memory.by_type(e, "fix", 3).collect()] == [1, 3, 5]
    assert [r.id for r in memory.by_project(e, "p2", 9).collect()] == [2, 5, 8]
    assert [r.id for r in memory.popular(e, 3).collect()] == [2, 7, 4]
    assert [r.id for r in memory.recent(e, 2).collect()] == [2, 9]
    got = {(r.fact, r.value): r.n for r in memory.statistics(e, ["memory_type"]).collect()}
    assert got == {("total", ""): 10, ("memory_type", "fix"): 5, ("memory_type", "note"): 5}
    names = spark.createDataFrame([("fold",), ("foo",), ("foo",), ("bar",)], "name string")
    assert [r.name for r in memory.completions(names, F.lit("fo"), 5).collect()] == ["fold", "foo"]


def test_learned_config(spark):
    runs = spark.createDataFrame([("k", 1, 1), ("k", 2, 2), ("k", 3, 3)], "k string, ts int, id int")
    bad = spark.createDataFrame([("k", 1, 10, "R", "f"), ("k", 1, 11, "R", "g"), ("k", 3, 12, "R", "f")], "k string, run int, violation int, rule_id string, file string")
    ok = spark.createDataFrame([("k", 10), ("k", 12), ("k", 99)], "k string, violation int")
    rates, white = memory.learned_config(runs, bad, ok, ["k"])
    want = 0.0
    for n in (2, 0, 1):
        want = 0.1 * n + 0.9 * want
    r = rates.first()
    assert r.samples == 3 and abs(r.violation_rate - want) < 1e-12
    assert [tuple(r) for r in white.collect()] == [("k", "R", "f")]


def test_exemptions_in_use_and_revised(spark):
    ex = spark.createDataFrame([("a", "R"), ("b", "S")], "id string, rule_id string")
    v = spark.createDataFrame([("a", 1), ("a", 5), (None, 9)], "exemption string, ts int")
    assert {(r.id, r.applications, r.last_used) for r in memory.applied(ex, v).collect()} == {("a", 2, 5), ("b", 0, None)}
    new = spark.createDataFrame([("b", "T"), ("c", "U")], "id string, rule_id string")
    assert {tuple(r) for r in memory.revised(ex, new, ex.filter("id = 'a'")).collect()} == {("b", "T"), ("c", "U")}


def test_imports_and_contracts(spark):
    rows = [("clippy", "x", "correctness", "p", "c", "rust", "u1"), ("eslint", "y", "1", "p", "c", None, "u2"), ("pylint", "z", "C", "q", "c", "python", "u3"), ("cwe", "79", "High", "r", "other", None, "u4"), ("clippy", "w", "pedantic", "s", "c", "rust", "u5")]
    records = spark.createDataFrame(rows, "source string, code string, level string, pattern string, domain string, language string, reference string")
    got = {r.pattern: (r.rule_id, r.severity, r.refs) for r in memory.imported(records, "info", ["rust", "python"], ["c"]).collect()}
    assert got == {"p": ("CLIPPY-x", "error", ["u1", "u2"]), "q": ("PYLINT-z", "info", ["u3"])}
    hist = spark.createDataFrame([("suffix", "Error", 6), ("suffix", "Config", 3), ("suffix", "X", 1), ("prefix", "get", 9)], "name string, value string, n long")
    got = {r.rule_type: (r.allowed, round(r.confidence, 3), r.severity) for r in memory.generated_contracts(hist, {"suffix": 2, "prefix": 8}, 0.95).collect()}
    assert got == {"suffix": (["Error", "Config"], 0.9, "info"), "prefix": (["get"], 1.0, "warning")}


def test_totals_parameters_and_decisions(spark):
    v = spark.createDataFrame([("a", True), ("b", False)], "f string, passed boolean")
    found = spark.createDataFrame([("b", "error", 2), ("b", "warning", 3), ("a", "info", 1)], "f string, severity string, count long")
    assert tuple(memory.run_totals(v, found).first()) == (2, 1, 1, 6, 2, 3)
    rows = spark.createDataFrame([("f", "fn a(&self, x: u8, y: u8) {"), ("f", "def b():"), ("f", "x = a(1, 2)")], "f string, content string")
    r = memory.parameters(rows, ["f"]).first()
    assert (r.functions, r.params, r.most) == (2, 2, 2)
    d = memory.decision(spark.createDataFrame([("block", "inviolable", 0.5, "SEC001"), ("warn", "flexible", 0.9, "X")], "action string, tier string, confidence double, rule_id string")).collect()
    assert [(r.decision.reason, r.decision.overridable) for r in d] == [("inviolable rule SEC001", False), ("reported", True)]


def test_index_is_kept_changed_and_searched(spark):
    docs = spark.createDataFrame([(1, "memory safety rules"), (2, "python typing rules"), (3, "cooking pasta")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "memory rules"), (2, "pasta")], "item_id long, text string")
    hits = lambda x: {(r["query"], r.id): round(r.score, 9) for r in x.collect()}
    index = search.TermIndex.build(docs)
    assert index.documents == 3 and index.exists()
    assert hits(index.search(q, 5)) == hits(search.tfidf_search(docs, q, 5))
    changed = index.replaced(spark.createDataFrame([(3, "memory of rules"), (4, "new pasta")], "doc_id long, text string")).removed(spark.createDataFrame([(2,)], "id long"))
    now = spark.createDataFrame([(1, "memory safety rules"), (3, "memory of rules"), (4, "new pasta")], "doc_id long, text string")
    assert changed.documents == 3
    assert hits(changed.search(q, 5)) == hits(search.tfidf_search(now, q, 5))


@pytest.mark.parametrize("secret", [b"k", b"x" * 100])
def test_signature_is_an_hmac(spark, secret):
    c = spark.createDataFrame([("i", "h", True, 1, 2, 3, "é")], "id string, file_hash string, passed boolean, errors int, warnings int, ts long, agent string")
    assert certify.signed(c, secret).first().signature == hmac.new(secret, "i:h:true:1:2:3:é".encode(), hashlib.sha256).hexdigest()


def test_watched_paths_expire(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "path string, ts timestamp, mtime long, size long"
    t = datetime(2024, 1, 1)
    for part in ([("a.py", t, 1, 5), ("b.py", t, 1, 5), ("c.txt", t, 1, 5), ("d.py", t, 1, 500)], [("b.py", t + timedelta(minutes=50), 2, 5)], [("b.py", t + timedelta(minutes=90), 3, 5)], [("b.py", t + timedelta(minutes=95), 3, 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        rows = stateful.watched(spark.readStream.schema(schema).parquet(src), ["py"], 100)
        windows.to_table(stateful.watch(rows, 3_600_000), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = [(r.path, r.change) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == [("a.py", "added"), ("a.py", "expired"), ("b.py", "added"), ("b.py", "changed"), ("b.py", "changed")]


def test_entries_sink_through_the_tiers(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "id long, ts timestamp"
    t = datetime(2024, 1, 1)
    for m in (0, 10, 20, 90, 95):
        part = [(2, t + timedelta(minutes=m))] + ([(1, t)] if m == 0 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        windows.to_table(stateful.tiers(spark.readStream.schema(schema).parquet(src), 300_000, 3_600_000), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = [r.event for r in spark.read.parquet(f"{tmp_path}/out").filter("id = 1").orderBy("event").collect()]
    assert got == ["long", "medium", "stored"]
