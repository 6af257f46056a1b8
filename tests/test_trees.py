"""Element trees and property graphs against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import trees

KINDS = ["p", "ul", "li", "if", "br"]


def markup(rng, depth=0):
    """Well-nested markup with elements that are never closed and closing tags without an element."""
    out = []
    for _ in range(rng.randint(0, 4 if depth < 5 else 0)):
        k = rng.choice(KINDS)
        out.append("<br>" if k == "br" else f"<{k} a='1'>{markup(rng, depth + 1)}</{k.upper()}>")
    return "x".join(out)


def parsed(text):
    """Rows of the tree by a stack; the only elements that are not closed are line breaks."""
    import re

    rows, stack = [], []
    tags = re.findall(trees.TAG, text)
    for i, tag in enumerate(tags):
        name = tag.lstrip("</").lower()
        if not tag.startswith("</"):
            rows.append([i, stack[-1][0] if stack else None, len(stack), i, name])
            if name != "br":
                stack.append(rows[-1])
        elif stack and stack[-1][4] == name:
            stack.pop()[3] = i
    return rows


def edges(rows, names):
    by, out = {r[0]: r for r in rows}, []
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    for parent, children in kids.items():
        if parent is None:
            continue
        out += [(parent, c[0], "ast") for c in children] + [(a[0], b[0], "cfg_next") for a, b in zip(children, children[1:], strict=False)]
        blocks = [c[0] for c in children if c[4] in ("p", "li")]
        if by[parent][4] == "if":
            out += [(parent, b, k) for b, k in zip(blocks, ["cfg_true", "cfg_false"], strict=False)]
        if by[parent][4] == "ul" and blocks:
            out.append((blocks[0], parent, "cfg_back"))
    for u in rows:
        use = names[u[0] * 7 % len(names)]
        if use is None:
            continue
        scopes, at = {None}, u[1]
        while at is not None:
            scopes.add(at)
            at = by[at][1]
        seen = [f[0] for f in rows if f[0] < u[0] and names[f[0] % len(names)] == use and f[1] in scopes]
        if seen:
            out.append((max(seen), u[0], "def_use"))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [(i, markup(rng)) for i in range(60)] + [(100, "</p>" * 3 + "<p><ul>" + "<li></li>" * 400 + "</ul></p></li><p></p>"), (101, "<p>" * 200 + "</p>" * 200)]


@pytest.fixture(scope="module")
def tree(spark, texts):
    df = spark.createDataFrame([(*t, 1, "z") for t in texts], "id long, html string, depth int, asks string").repartition(3)
    return trees.element_tree(df, "id").persist()


def test_tree(tree, texts):
    assert sorted(map(tuple, tree.collect()), key=str) == sorted(((i, *r) for i, t in texts for r in parsed(t)), key=str)


def test_edges(tree, texts):
    names = ["a", None, "b", "a", "c"]
    pick = lambda n: F.element_at(F.array(*(F.lit(x).cast("string") for x in names)), (n % len(names) + 1).cast("int"))
    out = trees.property_edges(tree, "id", ["if"], ["ul"], ["p", "li"], pick(F.col("node")), pick(F.col("node") * 7))
    assert sorted(map(tuple, out.collect())) == sorted((i, *e) for i, t in texts for e in edges(parsed(t), names))


def test_scopes_that_have_ended_are_not_seen(spark):
    """The inner definition holds inside its block alone, and the outer one after it again."""
    rows = [(1, 0, None, 0, 9, "f"), (1, 1, 0, 1, 1, "def"), (1, 2, 0, 1, 6, "block"), (1, 3, 2, 2, 3, "def"), (1, 5, 2, 2, 5, "use"), (1, 8, 0, 1, 8, "use"), (2, 0, None, 0, 0, "use")]
    df = spark.createDataFrame(rows, "id long, node int, parent int, depth int, last int, kind string")
    x = lambda k: F.when(F.col("kind") == k, "x")
    assert sorted(map(tuple, trees.def_use(df, "id", x("def"), x("use")).select("id", "src", "dst").collect())) == [(1, 1, 8), (1, 3, 5)]


def test_raw_content_comments_and_unclosed(spark):
    html = "<html><!-- <p> --><script>var t='</p><p>';</script><p><b>x<p>y</p></p><STYLE a=b><q></STYLE>"
    got = {(r.node, r.parent, r.depth, r.last, r.kind) for r in trees.element_tree(spark.createDataFrame([(1, html)], "id long, html string"), "id").collect()}
    assert got == {(0, None, 0, 0, "html"), (1, None, 0, 2, "script"), (3, None, 0, 7, "p"), (4, 3, 1, 4, "b"), (5, 3, 1, 6, "p"), (8, None, 0, 9, "style")}


def test_nothing_and_names(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no markup < 3"), (4, "</p>")], "id long, html string")
    tree = trees.element_tree(df, "id")
    assert tree.count() == 0
    assert trees.property_edges(tree, "id", defines=F.col("kind"), uses=F.col("kind")).count() == 0
    with pytest.raises(ValueError, match="rename"):
        trees.element_tree(df.withColumnRenamed("id", "node"), "node")


def test_parts_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(trees, "PART", 100, raising=False)
    texts = spark.createDataFrame([(i, "<p><b>x</b></p>" * 4) for i in range(20)], "i long, html string")
    assert trees.element_tree(texts, "i").rdd.getNumPartitions() == 12
    assert trees.element_tree(texts, "i").count() == 160
