import pytest
from pyspark.sql import functions as F

from siltstone.functions import scores
from siltstone.functions.text import cosine, glob_regex, jaccard, naming_style, pascal_case, screaming_case, snake_case, stem, terms_with_bigrams, word_set
from siltstone.functions.text import lines as text_lines
from siltstone.operators import lines, rules
from siltstone.operators.patterns import PatternError, parse
from siltstone.sources.tables import load_pack


@pytest.mark.parametrize(
    ("spec", "text", "n"),
    [
        ("text:a.b", "a.b axb a.b", 2),
        ("regex:a.b", "a.b axb", 2),
        ("a.b", "a.b axb", 2),
        ("plain", "plain plain", 2),
        ("aa", "aaaa", 2),
        ("regex:[0-9]+", "1 22 333", 3),
        ("and:x,y", "x y x", 2),
        ("and:x,z", "x y x", 0),
        ("or:x,y", "x y x", 3),
        ("not:z", "x", 1),
        ("not:x", "x", 0),
        ("(", "a ( b", 1),
        ("text:$", "$$$", 3),
    ],
)
def test_counts(spark, spec, text, n):
    df = spark.createDataFrame([(text,)], "t string")
    p = parse(spec)
    row = df.select(p.count(F.col("t")).alias("n"), p.found(F.col("t")).alias("f")).first()
    assert (row.n, row.f) == (n, n > 0)


@pytest.mark.parametrize("spec", ["regex:(?=x)", "regex:(?<!a)b", r"regex:(a)\1", "text:", "and:", ""])
def test_refused(spec):
    with pytest.raises(PatternError):
        parse(spec)


def test_findings_and_verdicts(spark):
    docs = spark.createDataFrame([(1, "ok\nbad bad\nbad"), (2, "fine"), (3, None), (4, "bad\r\nworse\r\n")], "id long, text string")
    pack = [rules.Rule("R1", "text:bad", "error"), rules.Rule("R2", "worse", "warning"), rules.Rule("R3", "not:fine", "hint")]
    found = {(r.id, r.rule_id): (r["count"], r.lines, r.line) for r in rules.findings(docs, pack, ["id"]).collect()}
    assert found[1, "R1"] == (3, [2, 3], 2) and found[4, "R1"] == (1, [1], 1) and found[4, "R2"] == (1, [2], 2)
    assert (2, "R3") not in found and found[3, "R3"] == (1, [1], 1)
    verdict = {r.id: r for r in rules.verdicts(docs, rules.findings(docs, pack, ["id"]), ["id"]).collect()}
    assert verdict[1].n_error == 3 and not verdict[1].passed and verdict[1].quality == 70.0
    assert verdict[2].passed and verdict[2].score == 1.0
    assert rules.findings(docs, [], ["id"]).count() == 0
    assert rules.findings(docs.limit(0), pack, ["id"]).count() == 0


def test_language_gate(spark):
    docs = spark.createDataFrame([(1, "x", "rust"), (2, "x", "python")], "id long, text string, language string")
    out = rules.findings(docs, [rules.Rule("R", "x", language="rust")], ["id"], language_col="language").collect()
    assert [r.id for r in out] == [1]


def test_lines(spark):
    df = spark.createDataFrame([("a\r\nb\n\nc\n",), ("",), (None,), ("x",), ("\n",)], "t string")
    assert [r.l for r in df.select(text_lines(F.col("t")).alias("l")).collect()] == [["a", "b", "", "c"], [], [], ["x"], [""]]


def test_depth_never_goes_below_zero(spark):
    steps = [1, -1, -1, 1, 1, -1, -1, -1, 1]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(steps)], "k int, line int, s int")
    out = [r.depth for r in lines.depth(df, ["k"], F.col("s")).orderBy("line").collect()]
    want, d = [], 0
    for s in steps:
        d = max(0, d + s)
        want.append(d)
    assert out == want


def test_islands_and_context(spark):
    df = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate("xx.xxx.x")], "k int, line int, c string")
    assert [(r.first_line, r.length) for r in lines.islands(df, ["k"], F.col("c") == "x", 2).collect()] == [(4, 3)]
    near = df.select("line", lines.near_lines(df, ["k"], F.col("c") == ".", 1, 0).alias("n")).filter("n").collect()
    assert sorted(r.line for r in near) == [3, 4, 7, 8]


@pytest.mark.parametrize(("text", "early", "unbalanced"), [("(a)", False, False), (")(", True, False), ("((", False, True), ("", False, False), (None, False, False), ("{[}]", False, False)])
def test_balance(spark, text, early, unbalanced):
    r = lines.balance(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first()
    assert (r.early_close, r.unbalanced) == (early, unbalanced)


def test_naming(spark):
    df = spark.createDataFrame([("fooBarBaz",), ("FooBar",), ("foo_bar",), ("FOO_BAR",), ("foo-Bar_x",)], "n string")
    rows = df.select(naming_style(F.col("n")).alias("s"), snake_case(F.col("n")).alias("a"), pascal_case(F.col("n")).alias("b"), screaming_case(F.col("n")).alias("c")).collect()
    assert [r.s for r in rows] == ["camel", "pascal", "snake", "screaming", "mixed"]
    assert (rows[0].a, rows[0].b, rows[0].c) == ("foo_bar_baz", "FooBarBaz", "FOO_BAR_BAZ")


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(glob_regex(g), p))
    assert hit("src/*.rs", "src/a.rs") and not hit("src/*.rs", "src/x/a.rs") and hit("src/**", "src/x/a.rs") and hit("?.py", "a.py") and not hit("a.py", "axpy")


def test_terms(spark):
    df = spark.createDataFrame([("The running of tests, é x1",)], "t string")
    assert df.select(terms_with_bigrams(F.col("t")).alias("x")).first().x == ["runn", "test", "é", "x1", "runn_test", "test_é", "é_x1"]
    # the first suffix of the list counts, once, and only where more than two bytes stand before it
    stems = {"ing": "ing", "organization": "organize", "relational": "relate", "payments": "payment", "cities": "citi", "nationally": "national", "wishes": "wish", "red": "red", "hopefulness": "hopeful"}
    assert df.select(*(stem(F.lit(x)).alias(x) for x in stems)).first().asDict() == stems


def test_similarity(spark):
    df = spark.createDataFrame([("a b c", "B c d", [1.0, 0.0], [1.0, 1.0])], "a string, b string, v array<double>, w array<double>")
    r = df.select(jaccard(word_set(F.col("a")), word_set(F.col("b"))).alias("j"), cosine(F.col("v"), F.col("w")).alias("c"), cosine(F.col("v"), F.array(F.lit(0.0))).alias("z"), jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("e")).first()
    assert (r.j, round(r.c, 6), r.z, r.e) == (0.5, 0.707107, 0.0, 0.0)


def test_scores(spark):
    r = spark.range(1).select(scores.quality(F.lit(2), F.lit(3), F.lit(4)).alias("q"), scores.quality(F.lit(20), F.lit(0), F.lit(0)).alias("z"), scores.file_score(F.lit(1.5)).alias("f"), scores.multi_signal(F.lit(1.0), F.lit(30), F.lit(1.0)).alias("m"), scores.severity_rank(F.lit("error")).alias("s")).first()
    assert (r.q, r.z, r.f, round(r.m, 6), r.s) == (72.0, 0.0, 0.0, 0.85, 1)


def test_whitelist(spark):
    found = spark.createDataFrame([("R1", "src/a.py"), ("R1", "lib/a.py"), ("R2", "src/a.py")], "rule_id string, path string")
    white = spark.createDataFrame([("R1", "src/**", None), ("R2", "**", "2020-01-01")], "rule_id string, glob string, e string").select("rule_id", "glob", F.to_timestamp("e").alias("expires_at"))
    out = {(r.rule_id, r.path): r.suppressed for r in rules.whitelisted(found, white, "path", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert out == {("R1", "src/a.py"): True, ("R1", "lib/a.py"): False, ("R2", "src/a.py"): False}


def test_packs():
    text = '{"contracts": [{"id": "A", "severity": "error", "tags": ["Rust"], "rules": [{"pattern": "x"}, {"pattern": "not:y", "message": "m"}]}, {"id": "B", "tags": ["all"], "rules": [{"pattern": "z"}]}]}'
    assert [r.rule_id for r in load_pack(text)] == ["A.0", "A.1", "B"]
    assert [r.rule_id for r in load_pack(text, "python")] == ["B"]
    assert load_pack('[[contracts]]\nid = "T"\n[[contracts.rules]]\npattern = "q"\n')[0].rule_id == "T"
