"""Graphs, drift, state, duplicates, code, sources and streams on small frames."""

import subprocess
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import certify, code, components, dedup, drift, graph, layers, lines, search, state
from siltstone.sources import files, tables
from siltstone.streaming import stateful, windows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


G = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "e"), ("e", "e")]


def test_reach_and_impact(spark):
    e = edges(spark, G)
    got = {r.node: r.depth for r in graph.reach(e, nodes(spark, ["a"]), 10).collect()}
    assert got == {"b": 1, "c": 2, "d": 3, "e": 4}
    assert {r.node for r in graph.reach(e, nodes(spark, ["a"]), 2).collect()} == {"b", "c"}
    out = {r.node: (r.affected, r.risk) for r in graph.impact(e, nodes(spark, ["e", "x", "a"])).collect()}
    assert out == {"e": (5, "medium"), "x": (0, "low"), "a": (2, "low")}
    assert graph.reach(e.limit(0), nodes(spark, ["a"]), 3).count() == 0


def test_chains_cycles_levels(spark):
    e = edges(spark, G)
    paths = {(r.start, r.goal): r.path for r in graph.chains(e, nodes(spark, ["a"]), nodes(spark, ["e", "x"]), 10).collect()}
    assert paths == {("a", "e"): ["a", "b", "c", "d", "e"]}
    assert sorted(r.path for r in graph.cycles(e, 5).collect()) == [["a", "b", "c"], ["e"]]
    level = {r.node: r.level for r in graph.levels(edges(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("p", "q"), ("q", "p"), ("r", "q")])).collect()}
    assert level == {"c": 0, "b": 1, "a": 2, "p": None, "q": None, "r": None}


def test_property_features(spark):
    n = spark.createDataFrame([("f", 0, 1, 3, 12, 2, True, False), ("g", 8, 2, 1, 1, 0, False, True), ("h", 17, 0, 0, 0, 0, False, False)], "node string, kind int, depth int, complexity int, loc int, params int, public boolean, documented boolean")
    e = spark.createDataFrame([("f", "g", "call"), ("f", "g", "cfg"), ("f", "g", "dfg")], "src string, dst string, kind string")
    got = {r.node: r.features for r in graph.property_features(n, e).collect()}
    assert got["f"] == [1.0] + [0.0] * 17 + [0.05, 0.3, 0.12, 0.2, 1.0, 0.0, 1.0, 0.0, 0.0, 0.15, 0.075, 1.0, 1.0, 1.0, 1.0, 1.0]
    assert got["g"][18:] == [0.1, 0.1, 0.01, 0.0, 0.0, 1.0, 0.0, 1.0, 0.15, 0.0, 0.075, 1.0, 1.0, 1.0, 0.0, 1.0] and got["g"][8] == 1.0
    assert got["h"] == [0.0] * 17 + [1.0] + [0.0] * 16


def test_resolution(spark):
    n = spark.createDataFrame([("f1::a", "a"), ("f2::a", "a"), ("f1::b", "b")], "node_id string, name string")
    c = spark.createDataFrame([("m", "f1::a"), ("m", "other::a"), ("k", "b"), ("k", "gone")], "src string, ref string")
    assert sorted(tuple(r) for r in graph.resolve(n, c).collect()) == [("k", "f1::b"), ("m", "f1::a"), ("m", "f2::a")]


def test_layers_and_supersedes(spark):
    layers = spark.createDataFrame([("a", "ui"), ("b", "core"), ("c", "db")], "node string, layer string")
    out = graph.layer_violations(edges(spark, [("a", "b"), ("b", "a"), ("a", "c")]), layers, [("ui", "core"), ("core", "db")]).collect()
    assert sorted((r.src, r.dst) for r in out) == [("a", "c"), ("b", "a")]
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "old int, new int")
    got = {r.id: (r.latest, r.steps) for r in graph.supersedes(links).collect()}
    assert got == {i: (20, 20 - i) for i in range(20)}


def test_depth_weighted_mean(spark):
    """Worked by hand: files of depths 0, 1, 1, 2, 2."""
    rows = [("r", 0, 0.05), ("s", 1, 0.15), ("t", 1, 0.10), ("u", 2, 0.30), ("v", 2, 0.02)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, node string, depth int, score double")
    r = drift.depth_weighted(df, ["k"]).first()
    assert abs(r.weighted - 0.105) < 0.01 and r.worst == "u" and r.concerning == 1 and r.advice == "watch"


def test_trends(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("f", t0 + timedelta(days=i), 0.9 - 0.1 * i, 0.5, 0.5 + 0.01 * i, 0.2 + 0.04 * i, 0.3) for i in range(3)]
    df = spark.createDataFrame(rows, "file string, ts timestamp, type_strictness double, naming_consistency double, error_handling double, complexity double, dead_code double")
    t = {r.metric: (r.direction, r.severity) for r in drift.trends(df, ["file"]).collect()}
    assert t["type_strictness"] == ("declining", "high") and t["complexity"] == ("declining", "medium") and t["naming_consistency"][0] == "stable"
    s = drift.drift_score(drift.trends(df, ["file"]), ["file"]).first()
    assert abs(s.score - (0.2 * 0.25 * 2 + 0.08 * 0.2 * 1.5)) < 1e-9 and s.snapshots == 3
    assert drift.alerts(spark.createDataFrame([("a", 0.4, 3), ("b", 0.4, 2), ("c", 0.2, 5), ("d", 0.1, 9)], "f string, score double, snapshots long")).count() == 2


@pytest.mark.parametrize(("values", "kinds"), [((3, 2, 0), set()), ((20, 3, 2), {"cyclomatic"}), ((10, 5, 2), {"nesting"}), ((10, 3, 10), {"unwraps"}), ((20, 5, 10), {"cyclomatic", "nesting", "unwraps"})])
def test_anomalies(spark, values, kinds):
    df = spark.createDataFrame([("f", *values)], "f string, cyclomatic int, nesting int, unwraps int")
    assert {r.kind for r in drift.anomalies(df, ["f"]).collect()} == kinds


def test_ema(spark):
    vals = [1.0, 0.0, 1.0, 1.0]
    df = spark.createDataFrame([("k", i, i, v) for i, v in enumerate(vals)], "k string, ts int, id int, v double")
    want = 0.5
    for v in vals:
        want = 0.9 * want + 0.1 * v
    assert abs(drift.ema(df, ["k"], "v", start=0.5).first().ema - want) < 1e-12


def test_deltas_partition_the_current(spark):
    old = spark.createDataFrame([("r", "f", 1), ("r", "f", 2)], "rule string, file string, line int")
    new = spark.createDataFrame([("r", "f", 2), ("r", "g", 3)], "rule string, file string, line int")
    out = {(r.file, r.line): r.status for r in state.violation_delta(old, new, ["rule", "file", "line"]).collect()}
    assert out == {("f", 1): "fixed", ("f", 2): "persistent", ("g", 3): "new"}
    changes = {r.path: r.change for r in state.file_delta(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string"), spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "path string, hash string")).collect()}
    assert changes == {"a": "removed", "b": "unchanged", "c": "modified", "d": "added"}


def test_compliance_learns_at_the_third_hit(spark):
    rows = [("STYLE9", "style", "a", i, i, 0.9, None) for i in range(5)] + [("SEC001", "x", "a", 9, 9, 0.9, "e"), ("STYLE9", "style", "b", 1, 7, 0.1, None), ("Q", "memory", "b", 1, 8, 0.9, "e")]
    df = spark.createDataFrame(rows, "rule_id string, domain string, path string, ts int, id int, confidence double, exemption string")
    got = {r.id: r.action for r in state.compliance(df).collect()}
    assert [got[i] for i in range(5)] == ["warn", "warn", "learn", "accept", "accept"]
    assert (got[9], got[7], got[8]) == ("block", "ask", "accept")


def test_exemptions_first_match_wins(spark):
    v = spark.createDataFrame([("R", "src/a.py"), ("R", "src2/a.py"), ("S", "x")], "rule_id string, path string")
    e = spark.createDataFrame([("e2", "R", "project", "", 2), ("e1", "R", "dir", "src", 1)], "id string, rule_id string, scope_kind string, scope_value string, ordinal int")
    assert {(r.rule_id, r.path): r.exemption for r in state.exempted(v, e).collect()} == {("R", "src/a.py"): "e1", ("R", "src2/a.py"): "e2", ("S", "x"): None}


def test_config_merge(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"b": 1.0, "c": 3.0})], "x map<string,double>, y map<string,double>")
    r = df.select(state.merged_thresholds(F.col("x"), F.col("y")).alias("m"), state.layered(F.col("x"), F.col("y")).alias("l")).first()
    assert r.m == {"a": 1.0, "b": 1.0, "c": 3.0} and r.l == {"a": 1.0, "b": 1.0, "c": 3.0}


def test_near_pairs_and_merge(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "z y"), (4, "a b c d e f g h i j"), (5, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.a, r.b): round(r.score, 4) for r in dedup.near_pairs(df, "id", "text", 0.8).collect()}
    assert got == {(1, 2): 0.8182}
    t = datetime(2024, 1, 1)
    e = spark.createDataFrame([("k", "i1", t, 5, ["x"], True), ("k", "i2", t + timedelta(days=1), 2, ["y", "x"], None)], "k string, id string, created_at timestamp, recall_count int, errors array<string>, helpful boolean")
    r = dedup.merged(e, ["k"]).first()
    assert (r.id, r.recall_count, r.created_at, r.errors, r.helpful, r.merged) == ("i2", 5, t, ["x", "y"], True, 2)


def test_search(spark):
    docs = spark.createDataFrame([(1, "memory safety rules"), (2, "python typing rules"), (3, "cooking pasta")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "memory rules"), (2, "zzz")], "item_id long, text string")
    hits = search.tfidf_search(docs, q, 5).orderBy("rank").collect()
    assert [r.id for r in hits] == [1, 2] and hits[0].score > hits[1].score
    v = spark.createDataFrame([(i, [float(i == 1), float(i == 2), 1.0]) for i in range(4)] + [(9, [0.0, 0.0, 0.0]), (8, [1.0])], "vec_id long, embedding array<float>")
    near = search.vector_search(v, v.filter("vec_id = 1"), 2, rows=2, block=1).orderBy("rank").collect()
    assert [r.id for r in near] == [0, 3] and abs(near[0].score - 0.707107) < 1e-6


PY = '''
import os
X = 1 + "a"
def outer(a, b: int):
    unused = 1
    a = X
    def inner():
        return a + undefined_name
    return helper(inner())
class C:
    def m(self, q):
        return os.path
'''


def test_python_code(spark):
    df = spark.createDataFrame([("f.py", PY), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    n = code.python_nodes(df, ["path"])
    assert code.tree_stats(n, ["path"]).filter("path = 'f.py'").first().max_depth > 3
    assert n.filter("path = 'bad.py'").count() == 0
    assert code.matching(n, ["path"], "FunctionDef", having=["FunctionDef"]).first().name == "outer"
    assert {r.name for r in code.matching(n, ["path"], "FunctionDef", without=["FunctionDef"]).collect()} == {"inner", "m"}
    issues = {(r.issue, r.name) for r in code.scope_issues(df, ["path"]).collect()}
    assert {("SCOPE001", "unused"), ("SCOPE002", "undefined_name"), ("SCOPE002", "helper"), ("SCOPE001", "b"), ("SCOPE001", "q")} == issues
    types = {(r.issue, r.detail) for r in code.type_issues(df, ["path"]).collect()}
    assert ("TYPE001", "int Add str") in types and ("TYPE002", "a") in types and ("TYPE002", "b") not in types
    nodes_, calls = code.call_table(df, "path")
    assert {r.node_id for r in nodes_.collect()} == {"f.py::outer", "f.py::inner", "f.py::m"}
    assert ("f.py::outer", "f.py::inner") in {tuple(r) for r in graph.resolve(nodes_, calls).collect()}


def test_blanked():
    src = 'let s = "a // b"; // c\n/* x\ny */ code # z\n\'q\' """t\n"u" v""" w'
    out = code.blanked(src)
    assert len(out) == len(src) and out.count("\n") == src.count("\n")
    assert "//" not in out and "c" not in out.split("\n")[0] and "code" in out and "w" in out and "z" not in out and "v" not in out


def test_signatures(spark):
    sig = spark.createDataFrame([("f", [("a", True), ("b", False)])], "function string, params array<struct<name:string,required:boolean>>")
    calls = spark.createDataFrame([("f", ["a"]), ("f", ["b", "z"])], "function string, args array<string>")
    out = code.signature_issues(calls, sig).collect()
    assert [(r.unknown, r.missing) for r in out] == [(["z"], ["a"])]


def test_learner(spark):
    df = spark.createDataFrame([("fn a_b() fn c_d() fn eF()",)], "text string")
    h = code.histograms(df, "text", {"fn": r"fn (\w)"})
    assert {(r.value, r.n) for r in h.collect()} == {("a", 1), ("c", 1), ("e", 1)}
    assert code.learned(spark.createDataFrame([("n", "x", 8), ("n", "y", 2)], "name string, value string, n long")).first().value == "x"


def test_scan(spark, tmp_path):
    for p, t in {"a.py": "x = 1", "src/b.rs": "fn main() {}", "node_modules/c.js": "no", ".git/d.py": "no", "big.py": "y" * 100, "Cargo.toml": '[dependencies]\nserde = "1.2"\nx = { version = "^3" }', "requirements.txt": "Flask==2.0\n# c\nreq>=1\nplain", "package.json": '{"dependencies": {"left": "*"}}', "pom.xml": "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    df = files.scan(spark, f"file://{tmp_path}", max_bytes=99)
    got = {r.path.rsplit("/", 1)[1]: r.language for r in df.collect()}
    assert got["a.py"] == "python" and got["b.rs"] == "rust" and "c.js" not in got and "d.py" not in got and "big.py" not in got
    deps = files.dependencies(df)
    assert {(r.ecosystem, r.package, r.version) for r in deps.collect()} == {("cargo", "serde", "1.2"), ("cargo", "x", "^3"), ("pip", "flask", "2.0"), ("pip", "req", "1"), ("pip", "plain", "*"), ("npm", "left", "*"), ("maven", "g:a", "1")}
    assert {r.package: r.issue for r in files.unpinned(deps).collect()} == {"x": "loose", "plain": "unpinned", "left": "unpinned"}
    v = spark.createDataFrame([("pip", "flask", "1.10", "2.0.1", "A", "high"), ("cargo", "serde", "1.10", "1.20", "B", "low")], "ecosystem string, package string, min_version string, max_version string, advisory string, severity string")
    assert [r.advisory for r in files.vulnerable(deps, v).collect()] == ["A"]  # 1.2 is below 1.10


def test_versions_and_git(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for i in (1, 2):
        tables.save_version(spark.range(i), path, i)
    assert [tuple(r) for r in tables.versions(spark, path).collect()] == [(2, 2), (1, 1)]
    assert tables.read_version(spark, path).count() == 2 and tables.read_version(spark, path, 1).count() == 1
    repo = tmp_path / "r"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    (repo / "f").write_text("1")
    git("add", "f")
    git("commit", "-qm", "one")
    (repo / "f").write_text("2")
    git("commit", "-qam", "two")
    spark.dataSource.register(tables.GitHistory)
    rows = spark.read.format("git_history").option("path", str(repo)).load().collect()
    assert sorted((r.path, r.status) for r in rows) == [("f", "A"), ("f", "M")]


def test_stores_memory_and_signatures(spark, tmp_path):
    path, schema = f"file://{tmp_path}/s", "id long, project string"
    tables.write_store(spark.createDataFrame([(1, "a"), (2, "b")], schema), path)
    tables.write_store(spark.createDataFrame([(3, "b")], schema), path)
    assert {tuple(r) for r in tables.read_store(spark, path, schema).collect()} == {(1, "a"), (3, "b")}
    got = tables.load_memory('[[entries]]\nid = "x"\ncode = "c"\nrecall_count = 3\nother = 1\n[[entries]]\nid = "y"')
    assert [(e["id"], e["recall_count"], e["errors"]) for e in got] == [("x", 3, []), ("y", 0, [])] and "other" not in got[0]
    assert tables.load_settings("a = 1\n[t]\nx = 2\ny = 'q'", "[t]\nx = 3") == {"a": "1", "t.x": "3", "t.y": '"q"'}
    sig = tables.load_signatures('{"json": {"loads": {"params": [{"name": "s"}, {"name": "cls", "required": false}], "returns": "object"}, "x": {}}}')
    assert sig == [("json.loads", [("s", True), ("cls", False)], "object"), ("json.x", [], None)]


def test_certificates(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    v = spark.createDataFrame([(1, True, 0, 0), (2, False, 2, 1)], "doc_id long, passed boolean, errors long, warnings long")
    certs = certify.signed(certify.issue(docs, "doc_id", "text", v, "me", 5), b"k")
    none = spark.createDataFrame([], "id string")
    assert all(r.valid for r in certify.verified(certs, b"k", none).collect())
    assert not any(r.valid for r in certify.verified(certs, b"other", none).collect())
    assert not any(r.valid for r in certify.verified(certs.withColumn("errors", F.col("errors") + 1), b"k", none).collect())
    assert {r.doc_id: r.valid for r in certify.verified(certs, b"k", certs.filter("doc_id = 1").select("id")).collect()} == {1: False, 2: True}


def test_stream_state_goes_on_where_it_ended(spark, tmp_path):
    """Hits in two runs over growing files are numbered as in one batch."""
    src = f"{tmp_path}/in"
    rows = [("R", "p", datetime(2024, 1, 1) + timedelta(hours=i), i) for i in range(6)]
    schema = "rule_id string, path string, ts timestamp, id long"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        windows.to_table(stateful.learn(spark.readStream.schema(schema).parquet(src)), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r.id: r.action for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [got[i] for i in range(6)] == ["warn", "warn", "learn", "accept", "accept", "accept"]


def test_hits_of_many_paths_share_a_group(spark, tmp_path, monkeypatch):
    """Rules and paths of one bundle, some without a name, are counted apart over three batches."""
    monkeypatch.setattr(stateful, "BUNDLES", 2)
    src, schema = f"{tmp_path}/in", "rule_id string, path string, ts timestamp, id long"
    names = ["a", "b", None]
    rows = [(names[i % 3], names[i // 3 % 3] and f"{i * 31 % 7}", datetime(2024, 1, 1) + timedelta(hours=i // 2), i) for i in range(300)]
    for part in (rows[:100], rows[100:150], rows[150:]):
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(src)
        windows.to_table(stateful.learn(spark.readStream.schema(schema).parquet(src)), f"{tmp_path}/out", f"{tmp_path}/ck")
    n, want = {}, {}
    for rule, path, _, i in rows:
        n[rule, path] = k = n.get((rule, path), 0) + 1
        want[i] = (rule, path, k, "warn" if k < 3 else "learn" if k == 3 else "accept")
    assert {r.id: (r.rule_id, r.path, r.occurrence, r.action) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_late_rows_are_dropped(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "ts timestamp, k string, v double"
    t = datetime(2024, 1, 1)
    for i, part in enumerate([[(t, "a", 1.0), (t + timedelta(hours=5), "a", 1.0)], [(t, "a", 1.0), (t + timedelta(hours=9), "a", 1.0)], [(t + timedelta(hours=12), "a", 1.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        windows.to_table(windows.tumbling(spark.readStream.schema(schema).parquet(src), "ts", "1 hour", "1 hour", ["k"], "v"), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r.start: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[t] == 1


def test_zz_scratch_is_cleared(spark, tmp_path):
    import os

    from siltstone.session import clear_scratch, saved, scratch_folder, shared_folder

    df = saved(spark.range(3))
    assert df.count() == 3
    other = shared_folder(spark).removeprefix("file://") + f"/siltstone/another-application-{uuid.uuid4().hex}"
    os.makedirs(other)
    clear_scratch(spark)
    assert not os.path.exists(scratch_folder(spark).removeprefix("file://"))
    assert os.path.isdir(other)  # other applications' tables stay
    os.rmdir(other)


def test_versions_compare_as_versions(spark):
    """Each before the next; all parts count, and a pre-release comes before its release."""
    order = ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0", "1.0.0.0.1", "1.0.0.0.2-rc1", "1.0.0.0.2", "1.2", "1.10b1", "1.10rc1", "v1.10", "2.0", "20240101", "20240101.0.7", "99999999999999999999"]
    df = spark.createDataFrame(list(enumerate(order)), "i int, v string").withColumn("k", files.version_key(F.col("v"))).withColumn("p", files._place(F.col("k")))
    rows = df.orderBy("k", "i").collect()
    assert [r.v for r in rows] == order
    assert [r.p for r in rows] == sorted(r.p for r in rows)
    same = df.filter("i = 0").select(*(files.version_key(F.lit(v)).alias(f"c{i}") for i, v in enumerate(("1.0", "1", "1.0.0.0", "v1.0+build.7")))).first()
    assert len({str(x) for x in same}) == 1


def test_ranges_by_bins_equal_all_ranges(spark):
    import random

    rng = random.Random(9)
    some = lambda: ".".join(str(rng.choice([0, 1, 2, 9, 31, 400, 70000])) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", "", "-rc.1"])
    deps = spark.createDataFrame([(i, "e", rng.choice("ab"), some()) for i in range(150)], "id int, ecosystem string, package string, version string")
    v = spark.createDataFrame([("e", rng.choice("ab"), some(), some(), i, "low") for i in range(200)], "ecosystem string, package string, min_version string, max_version string, advisory int, severity string")
    lo, hi, at = (files.version_key(F.col(c)) for c in ("min_version", "max_version", "version"))
    want = deps.join(v, ["ecosystem", "package"]).filter((at >= lo) & (at <= hi)).select("id", "advisory").collect()
    assert sorted(files.vulnerable(deps, v).select("id", "advisory").collect()) == sorted(want) and len(want) > 500


def test_scopes_of_exemptions(spark):
    paths = ["src/a.py", "src/x/b.py", "src2/a.py", "a.py", "src/x/y/c.rs"]
    scopes = [("dir", "src"), ("dir", "src/x"), ("file", "a.py"), ("glob", "src/*.py"), ("glob", "**/c.rs"), ("glob", "src/x/**"), ("glob", "a.py"), ("glob", "s?c/x/*"), ("project", "")]
    hits = {0: [0, 1, 4], 1: [1, 4], 2: [3], 3: [0], 4: [4], 5: [1, 4], 6: [3], 7: [1], 8: [0, 1, 2, 3, 4]}
    v = spark.createDataFrame([("R", p) for p in paths], "rule_id string, path string")
    for i, (kind, value) in enumerate(scopes):
        e = spark.createDataFrame([("e", "R", kind, value, 1), ("other", "S", "project", "", 0)], "id string, rule_id string, scope_kind string, scope_value string, ordinal int")
        got = {r.path for r in state.exempted(v, e).filter("exemption IS NOT NULL").collect()}
        assert got == {paths[k] for k in hits[i]}, (kind, value)


def test_audit_links_show_a_dropped_beginning(spark):
    rows = [("k", 1, "a", "x", "1"), ("k", 2, "b", "x", "2"), ("k", 3, "c", "x", "3"), ("k", 3, "c", "x", "3")]
    chain = lambda r: [x.link for x in certify.audit_chain(spark.createDataFrame(r, "key string, ts int, id string, action string, subject string"), "key").orderBy("seq").collect()]
    whole = chain(rows)
    assert len(set(whole)) == 4
    assert not set(whole) & set(chain(rows[1:]))
    changed = chain([rows[0], ("k", 2, "b", "x", "other"), *rows[2:]])
    assert changed[0] == whole[0] and not set(changed[1:]) & set(whole[1:])


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_and_chains_of_dense_graphs(spark, few, monkeypatch):
    """Many paths and no cycle: nothing is listed; components, chains and cycles of a small graph by hand."""
    monkeypatch.setattr(components, "FEW", few)
    dag = spark.createDataFrame([(i, j) for i in range(60) for j in range(i + 1, 60)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 103), (103, 104), (104, 103), (5, 100)], "src int, dst int")
    comp = {r.node: r.component for r in components.strong_components(dag).collect()}
    assert comp == {**{i: i for i in range(60)}, 100: 100, 101: 100, 102: 100, 103: 103, 104: 103}
    assert sorted(r.path for r in graph.cycles(dag).collect()) == [[100, 101, 102], [103], [103, 104]]
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "node int")
    found = {(r.start, r.goal): r.path for r in graph.chains(dag, one(0, 5, 104, 999), one(59, 104, 0)).collect()}
    assert found == {(0, 59): [0, 59], (5, 59): [5, 59], (0, 104): [0, 5, 100, 101, 102, 103, 104], (5, 104): [5, 100, 101, 102, 103, 104]}
    assert graph.chains(dag, one(0), one(104), 3).count() == 0


def test_merging_by_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 7), (20, 21)], "a int, b int")
    assert {r.ref: r.comp for r in components.connected(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_calls_have_the_definition_above(spark):
    sources = {
        "rust": "use a;\nstart();\npub async fn one(x: u8) {\n    two(x);\n    println!(\"three(x)\");\n    // four()\n    if (y) { v.push(six::seven(1)) }\n}\nfn eight() { one(1) }",
        "python": "def f(a):\n    return g(h(a))\nclass K:\n    async def m(self):\n        self.f()",
        "javascript": "const a = (x) => b(x)\nexport function c() {\n  d()\n}",
        "go": "func (s *T) Run() {\n\ts.stop()\n}",
        "c": "static int *make(int n) {\n  return grow(n);\n}",
    }
    df = spark.createDataFrame(list(sources.items()), "path string, text string")
    got = {}
    for lang in sources:
        rows = lines.line_table(df.filter(F.col("path") == lang), ["path"])
        got[lang] = [(r.line, r.caller, r.ref) for r in layers.calls(rows, ["path"], lang).orderBy("line").collect()]
        assert layers.definitions(rows, ["path"], lang).count() > 0
    assert got["rust"] == [(2, None, "start"), (4, "one", "two"), (5, "one", "println"), (7, "one", "v.push"), (7, "one", "six::seven"), (9, "eight", "one")]
    assert got["python"] == [(2, "f", "g"), (2, "f", "h"), (5, "m", "self.f")]
    assert got["javascript"] == [(1, "a", "b"), (3, "c", "d")]
    assert got["go"] == [(2, "Run", "s.stop")] and got["c"] == [(2, "make", "grow")]
