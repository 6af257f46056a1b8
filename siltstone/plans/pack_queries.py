"""Queries of the rule packs, items, notebooks and architecture over sources dealt to parts, and over pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..operators import code, graph, layers, lines, matching, packs, validate
from ..session import spread
from ..sources.tables import table
from . import pack, samples

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Parts to a task.
ROWS = 20_000


def _dealt(spark, d, values: Sequence, name: str):
    """Each part's number and one of the values."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("p_partkey") % len(values) + 1).cast("int")).alias(name)


def sources(spark, d):
    """(p_partkey, language, text), dealt to tasks before texts are made of the short rows."""
    p = spread(table(spark, d, "part").select("p_partkey"), ROWS, "p_partkey")
    return p.select("p_partkey", _dealt(spark, d, [x for x, _ in samples.SOURCES], "language"), _dealt(spark, d, [x for _, x in samples.SOURCES], "text"))


def _due(rows: Sequence[tuple], names: str, n: int) -> str:
    """SQL of the findings that are due."""
    lit = lambda v: "NULL::INT" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    cols = [c for c in names.split(", ") if c != "s"]
    return f"SELECT p_partkey, {', '.join(cols)} FROM part JOIN (VALUES {values}) v({names}) ON p_partkey % {n} = s"


_N = len(samples.SOURCES)
KEY = ["p_partkey"]


@query(_due(samples.LOGIC, "s, line, rule_id", _N))
def logic_pack(spark, d):
    rows = layers.flagged_lines(sources(spark, d), [*KEY, "language"])
    return layers.line_findings(rows, [*KEY, "language"], packs.LOGIC, "language").select("p_partkey", "rule_id", "line")


@query(_due(samples.SECURITY, "s, line, rule_id", _N))
def security_pack(spark, d):
    rows = layers.flagged_lines(sources(spark, d), KEY, rules=packs.SECURITY)
    return layers.line_findings(rows, KEY, packs.SECURITY, comment=layers.CODE_COMMENT).select("p_partkey", "rule_id", "line")


@query(_due(samples.FALLBACK, "s, line, rule_id", _N))
def fallback_pack(spark, d):
    rows = lines.line_table(sources(spark, d).filter("language = 'unknown'"), KEY)
    return layers.regex_findings(rows, KEY, packs.FALLBACK).select("p_partkey", "rule_id", "line")


@query(_due(samples.SUPPLY, "s, line, rule_id", _N))
def source_risks(spark, d):
    return layers.source_risks(lines.line_table(sources(spark, d), KEY), KEY).select("p_partkey", "rule_id", "line")


# a broken source has its syntax error alone; security is of known languages, its fallback of the others
_RUN = {"syntax": samples.SYNTAX, "ast": samples.ITEMS, "logic": [x for x in samples.LOGIC if x[0] != 8], "security": [x for x in samples.SECURITY if x[0] != 6], "fallback_security": samples.FALLBACK, "supply_chain": samples.SUPPLY}


@query(_due([(s, layer, sum(x[0] == s for x in rows)) for layer, rows in _RUN.items() for s in sorted({x[0] for x in rows})], "s, layer, n", _N))
def validation_run(spark, d):
    return validate.run(sources(spark, d), KEY).groupBy("p_partkey", "layer").agg(F.count(F.lit(1)).alias("n"))


# sources 0, 3, 4, 5, 6, 8 and 9 have an error
@query(f"SELECT count(*) AS files, count_if(p_partkey % {_N} IN (1, 2, 7)) AS passed, count_if(p_partkey % {_N} NOT IN (1, 2, 7)) AS failed FROM part")
def validation_totals(spark, d):
    texts = sources(spark, d)
    return validate.totals(texts, validate.run(texts, KEY), KEY).select("files", "passed", "failed")


# the pages have links and scripts: the same pack over lines of other make
@query("WITH l0 AS (SELECT page_id, string_split(html, chr(10)) AS a FROM pages), l AS (SELECT page_id, unnest(a) AS content, unnest(range(1, len(a) + 1)) AS line FROM l0), q AS (SELECT *, NOT regexp_matches(content, '^\\s*(//|/\\*|#)') AS code FROM l) SELECT page_id, 'SEC051' AS rule_id, count(*) AS n FROM q WHERE code AND contains(content, 'http://') AND (len(string_split(split_part(content, 'http://', 1), '\"')) - 1) % 2 = 0 GROUP BY page_id UNION ALL SELECT page_id, 'SEC122', count(*) FROM q WHERE code AND contains(content, 'document.write(') AND (len(string_split(split_part(content, 'document.write(', 1), '\"')) - 1) % 2 = 0 GROUP BY page_id")
def security_pages(spark, d):
    rows = lines.line_table(table(spark, d, "pages"), ["page_id"], "html")
    found = layers.line_findings(rows, ["page_id"], [r for r in packs.SECURITY if r.rule_id in ("SEC051", "SEC122")], comment=layers.CODE_COMMENT)
    return found.groupBy("page_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(_due(samples.ITEMS, "s, line, rule_id", _N))
def item_kinds(spark, d):
    return layers.items(lines.line_table(sources(spark, d), KEY), KEY, packs.ITEMS).select("p_partkey", "rule_id", "line")


@query(_due(samples.NOTEBOOK_ISSUES, "s, issue, cell", len(samples.NOTEBOOKS)))
def notebook_checks(spark, d):
    texts = table(spark, d, "part").select("p_partkey", _dealt(spark, d, samples.NOTEBOOKS, "text"))
    return code.notebook_issues(texts, KEY)


# files of a part's layer import modules of two other parts and, in some, banned, repeated and many ones
_ARCH = """WITH f AS (SELECT p_partkey, ['ui', 'application', 'domain', 'infrastructure'][1 + p_partkey % 4] AS layer, ['ui', 'application', 'domain', 'infrastructure'][1 + p_size % 4] AS target FROM part),
m AS (SELECT p_partkey, layer, target || '::m' || p_partkey AS module, false AS wildcard FROM f
  UNION ALL SELECT p_partkey, layer, 'diesel::prelude', true FROM f WHERE p_partkey % 5 = 0
  UNION ALL SELECT p_partkey, layer, 'std::x', false FROM (SELECT p_partkey, layer, unnest(range(1 + p_partkey % 23)) FROM f WHERE p_partkey % 7 = 0)),
a(x, y) AS (VALUES ('ui', 'application'), ('ui', 'domain'), ('application', 'domain'), ('application', 'infrastructure'), ('infrastructure', 'domain'))"""


@query(f"""{_ARCH}, r AS (SELECT p_partkey, 'ARCH004' AS rule_id, target || '::m' || p_partkey AS detail FROM f WHERE layer <> target AND NOT EXISTS (SELECT 1 FROM a WHERE x = layer AND y = target)
UNION ALL SELECT p_partkey, 'ARCH003', module FROM m WHERE layer = 'ui' AND module LIKE 'diesel::%'
UNION ALL SELECT p_partkey, 'ARCH006', module FROM m WHERE wildcard
UNION ALL SELECT p_partkey, 'ARCH002', module FROM m GROUP BY p_partkey, module HAVING count(*) > 1
UNION ALL SELECT p_partkey, 'ARCH005', count(*)::VARCHAR FROM m GROUP BY p_partkey HAVING count(*) > 20) SELECT * FROM r""")
def arch_rules(spark, d):
    names = F.array(*(F.lit(x) for x in packs.LAYER_MAY_USE))
    at = lambda c: F.element_at(names, (F.col(c) % 4 + 1).cast("int"))
    f = table(spark, d, "part").select("p_partkey", F.concat(F.lit("src/"), at("p_partkey"), F.lit("/f.rs")).alias("path"), at("p_size").alias("target"))
    own = F.array(F.struct(F.concat("target", F.lit("::m"), F.col("p_partkey").cast("string")).alias("module"), F.lit(False).alias("wildcard")))
    wild = F.when(F.col("p_partkey") % 5 == 0, F.array(F.struct(F.lit("diesel::prelude").alias("module"), F.lit(True).alias("wildcard")))).otherwise(F.array().cast("array<struct<module:string,wildcard:boolean>>"))
    std = F.when(F.col("p_partkey") % 7 == 0, F.array_repeat(F.struct(F.lit("std::x").alias("module"), F.lit(False).alias("wildcard")), (F.col("p_partkey") % 23 + 1).cast("int"))).otherwise(F.array().cast("array<struct<module:string,wildcard:boolean>>"))
    rows = f.select("p_partkey", "path", F.explode(F.concat(own, wild, std)).alias("i")).select("p_partkey", "path", "i.module", "i.wildcard")
    return layers.architecture(rows, KEY, layers.layer_of(F.col("path"), packs.LAYER_FOLDERS), packs.LAYER_MAY_USE, packs.FORBIDDEN_IMPORTS)


# modules in rings of three, and edges into the next ring
_RING = "WITH e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 3 = 2 THEN p_partkey - 2 ELSE p_partkey + 1 END AS dst FROM part WHERE p_partkey // 3 * 3 >= 3 AND p_partkey // 3 * 3 + 2 <= (SELECT max(p_partkey) FROM part) UNION ALL SELECT p_partkey, p_partkey + 5 FROM part WHERE p_partkey % 11 = 0 AND p_partkey + 5 <= (SELECT max(p_partkey) FROM part)), y AS (SELECT p_partkey AS node, ['ui', 'application', 'domain', 'infrastructure'][1 + p_size % 4] AS layer FROM part)"


@query(f"""{_RING} SELECT 'ARCH001' AS rule_id, src || ' -> ' || (src + 1) || ' -> ' || (src + 2) AS detail FROM e WHERE src % 3 = 0 AND dst = src + 1
UNION ALL SELECT 'ARCH007', src || ' -> ' || dst FROM e JOIN y a ON a.node = src JOIN y b ON b.node = dst WHERE a.layer <> b.layer AND a.layer || '>' || b.layer NOT IN ('ui>application', 'ui>domain', 'application>domain', 'application>infrastructure', 'infrastructure>domain')""")
def arch_graph(spark, d):
    p = table(spark, d, "part")
    most = p.agg(F.max("p_partkey")).first()[0] or 0
    ring = p.filter(f"p_partkey div 3 * 3 >= 3 AND p_partkey div 3 * 3 + 2 <= {most}").select(F.col("p_partkey").alias("src"), F.when(F.col("p_partkey") % 3 == 2, F.col("p_partkey") - 2).otherwise(F.col("p_partkey") + 1).alias("dst"))
    far = p.filter(f"p_partkey % 11 = 0 AND p_partkey + 5 <= {most}").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 5).alias("dst"))
    names = F.array(*(F.lit(x) for x in packs.LAYER_MAY_USE))
    where = p.select(F.col("p_partkey").alias("node"), F.element_at(names, (F.col("p_size") % 4 + 1).cast("int")).alias("layer"))
    return layers.architecture_graph(ring.union(far), where, packs.LAYER_MAY_USE)


# nodes of parts: 18 kinds, edges of three kinds
_CPG = """WITH n AS (SELECT p_partkey AS node, p_partkey % 18 AS kind FROM part), e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, ['ast', 'cfg', 'call'][1 + p_size % 3] AS kind FROM part WHERE p_partkey > 1),
g AS (SELECT node, count(*) FILTER (o) AS od, count(*) FILTER (NOT o) AS id, max((k = 'cfg')::INT) AS c, max((k = 'call')::INT) AS l FROM (SELECT src AS node, true AS o, kind AS k FROM e UNION ALL SELECT dst, false, kind FROM e) GROUP BY node)"""


@query(f"{_CPG} SELECT n.node, kind, round(coalesce(id, 0) / 20, 6) AS in_degree, round(coalesce(od, 0) / 20, 6) AS out_degree, coalesce(c, 0)::DOUBLE AS has_cfg, coalesce(l, 0)::DOUBLE AS has_call, (coalesce(id, 0) = 0 AND coalesce(od, 0) > 0)::INT::DOUBLE AS entry, round((coalesce(id, 0) + coalesce(od, 0)) / (SELECT max(id + od) FROM g), 6) AS centrality, 34 AS features FROM n LEFT JOIN g USING (node)")
def property_features(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 18).cast("int").alias("kind"), (F.col("p_partkey") % 5).alias("depth"), (F.col("p_size") % 7).alias("complexity"), F.col("p_size").alias("loc"), F.lit(0).alias("params"), F.lit(False).alias("public"), F.lit(False).alias("documented"))
    edges = p.filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"), F.element_at(F.array(F.lit("ast"), F.lit("cfg"), F.lit("call")), (F.col("p_size") % 3 + 1).cast("int")).alias("kind"))
    out = graph.property_features(nodes, edges)
    at = lambda i: F.round(F.col("features")[i], 6)
    kind = F.array_position(F.slice("features", 1, 18), F.lit(1.0)) - 1
    return out.select("node", kind.alias("kind"), at(26).alias("in_degree"), at(27).alias("out_degree"), at(29).alias("has_cfg"), at(31).alias("has_call"), at(32).alias("entry"), at(33).alias("centrality"), F.size("features").alias("features"))


# a pack of thousands of literal rules: all runs of two and of three words of the benchmark's items
_PHRASES = """WITH w AS (SELECT string_split(text, ' ') AS ws FROM benchmark),
i AS (SELECT ws, unnest(range(1, len(ws))) AS i FROM w),
p AS (SELECT DISTINCT unnest([ws[i] || ' ' || ws[i + 1], ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]]) AS needle FROM i),
n AS (SELECT needle, 'P-' || left(md5(needle), 12) AS rule_id FROM p WHERE needle IS NOT NULL)"""


def phrases(spark, d):
    """(rule_id, needle)."""
    words = table(spark, d, "benchmark").select(F.split("text", " ").alias("ws"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - n + 1)), lambda i: F.array_join(F.slice("ws", i, F.lit(n)), " "))
    whole = lambda n: F.when(F.size("ws") >= n, run(n)).otherwise(F.array().cast("array<string>"))
    needles = words.select(F.explode(F.concat(whole(2), whole(3))).alias("needle")).distinct()
    return needles.select(F.concat(F.lit("P-"), F.left(F.md5("needle"), F.lit(12))).alias("rule_id"), "needle")


def _phrase_sql(tab: str, key: str, col: str) -> str:
    before = "left(t, strpos(t, needle) - 1)"
    return f"""{_PHRASES}, t AS (SELECT {key}, coalesce({col}, '') AS t FROM {tab})
SELECT {key}, rule_id, CAST((strlen(t) - strlen(replace(t, needle, ''))) // strlen(needle) AS BIGINT) AS count,
  CAST(length({before}) - length(replace({before}, chr(10), '')) + 1 AS INT) AS line FROM t JOIN n ON contains(t, needle)"""


@query(_phrase_sql("documents", "doc_id", "text"))
def large_pack_documents(spark, d):
    return matching.literal_findings(table(spark, d, "documents"), phrases(spark, d), ["doc_id"])


@query(_phrase_sql("pages", "page_id", "html"))
def large_pack_pages(spark, d):
    return matching.literal_findings(table(spark, d, "pages"), phrases(spark, d), ["page_id"], "html")


@query(_phrase_sql("documents", "doc_id", "text"))
def large_pack_joined(spark, d):
    """The same, as for a pack that is too large to be sent to all tasks."""
    return matching.literal_findings(table(spark, d, "documents"), phrases(spark, d), ["doc_id"], pack_bytes=0)


# the packs over the lines of real tables; loops are of code, which these tables have none of
_LOGIC = [r for r in packs.LOGIC if r.context != "in_loop" and r.language is None]
_PACKS = {"logic": (_LOGIC, layers.COMMENT), "security": (packs.SECURITY, layers.CODE_COMMENT)}


def _packs_over(rows, key):
    """The three packs over one table of lines."""
    of = lambda found, layer: found.select(key, "line", F.lit(layer).alias("layer"), "rule_id")
    found = [of(layers.line_findings(rows, [key], rules, comment=comment), layer) for layer, (rules, comment) in _PACKS.items()]
    return found[0].unionByName(found[1]).unionByName(of(layers.regex_findings(rows, [key], packs.FALLBACK), "fallback_security"))


@query(pack.line_pack_sql("documents", "doc_id", "text", _PACKS, {"fallback_security": packs.FALLBACK}))
def packs_over_documents(spark, d):
    return _packs_over(lines.line_table(table(spark, d, "documents"), ["doc_id"]), "doc_id").distinct()


# a script may hold what a rule of code asks for, and a page links to others
_PAGE_RULES = [*packs.SECURITY, layers.LineRule("PAGE_SCRIPT", "<script", "warning"), layers.LineRule("PAGE_STYLE", "<style", "info"), layers.LineRule("PAGE_LINK", "<a href=", "info")]


@query(pack.line_pack_sql("pages", "page_id", "html", {"security": (_PAGE_RULES, layers.CODE_COMMENT)}, {"fallback_security": packs.FALLBACK}))
def packs_over_pages(spark, d):
    rows = lines.line_table(table(spark, d, "pages"), ["page_id"], "html")
    found = layers.line_findings(rows, ["page_id"], _PAGE_RULES, comment=layers.CODE_COMMENT).select("page_id", "line", F.lit("security").alias("layer"), "rule_id")
    return found.unionByName(layers.regex_findings(rows, ["page_id"], packs.FALLBACK).select("page_id", "line", F.lit("fallback_security").alias("layer"), "rule_id")).distinct()
