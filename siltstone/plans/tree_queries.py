"""Queries of element trees and property graphs over pages, and of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, runs, trees
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_TREE = f"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '{trees.COMMENTS}', '', 'g'), '{trees.RAW}', '\\1\\2', 'g') AS h FROM pages),
t0 AS (SELECT page_id, regexp_extract_all(h, '{trees.TAG}') AS a FROM h),
t1 AS (SELECT page_id, unnest(a) AS tag, unnest(range(0, len(a))) AS node FROM t0),
t2 AS (SELECT page_id, node, lower(ltrim(tag, '</')) AS kind, CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END AS step FROM t1),
t3 AS (SELECT *, sum(step) OVER (PARTITION BY page_id, kind ORDER BY node) AS s FROM t2),
t4 AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY page_id, kind ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM t3),
t5 AS (SELECT *, s - low + CASE WHEN step = -1 THEN 1 ELSE 0 END AS level FROM t4 WHERE step = 1 OR s >= low),
t6 AS (SELECT o.page_id, o.node, o.kind, min(c.node) AS last FROM t5 o LEFT JOIN t5 c ON c.page_id = o.page_id AND c.kind = o.kind AND c.level = o.level AND c.step = -1 AND c.node > o.node
  AND NOT EXISTS (SELECT 1 FROM t5 m WHERE m.page_id = o.page_id AND m.kind = o.kind AND m.level = o.level AND m.step = 1 AND m.node > o.node AND m.node < c.node)
  WHERE o.step = 1 GROUP BY o.page_id, o.node, o.kind),
t7 AS (SELECT a.page_id, a.node, a.kind, a.last, count(b.node) AS depth, max(b.node) AS inner_ FROM t6 a LEFT JOIN t6 b ON b.page_id = a.page_id AND b.node < a.node AND b.last > a.node GROUP BY ALL),
tree AS (SELECT page_id, CAST(node AS INT) AS node, CAST(inner_ AS INT) AS parent, CAST(depth AS INT) AS depth, CAST(coalesce(last, node) AS INT) AS last, kind FROM t7)"""


def page_nodes(spark, d):
    return trees.element_tree(table(spark, d, "pages"), "page_id")


@query(f"{_TREE} SELECT * FROM tree")
def page_tree(spark, d):
    return page_nodes(spark, d)


# of pages: a list goes through its items, an article or a menu through its parts, and what stands in the text refers to the block before it
_BRANCHES, _LOOPS, _BLOCKS = ["article", "body"], ["ul", "nav"], ["p", "li", "div", "ul"]
_DEFINE, _USE = ["p", "li", "h1", "title"], ["a", "b", "br", "p", "footer"]
_IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_EDGES = f"""{_TREE}, k AS (SELECT c.*, p.kind AS above, row_number() OVER (PARTITION BY c.page_id, c.parent, c.kind IN {_IN(_BLOCKS)} ORDER BY c.node) AS nth,
  lag(c.node) OVER (PARTITION BY c.page_id, c.parent ORDER BY c.node) AS prior FROM tree c JOIN tree p ON p.page_id = c.page_id AND p.node = c.parent),
edges AS (SELECT page_id, parent AS src, node AS dst, 'ast' AS kind FROM k
UNION ALL SELECT page_id, prior, node, 'cfg_next' FROM k WHERE prior IS NOT NULL
UNION ALL SELECT page_id, parent, node, CASE nth WHEN 1 THEN 'cfg_true' ELSE 'cfg_false' END FROM k WHERE above IN {_IN(_BRANCHES)} AND kind IN {_IN(_BLOCKS)} AND nth <= 2
UNION ALL SELECT page_id, node, parent, 'cfg_back' FROM k WHERE above IN {_IN(_LOOPS)} AND kind IN {_IN(_BLOCKS)} AND nth = 1
UNION ALL SELECT u.page_id, max(f.node), u.node, 'def_use' FROM tree u JOIN tree f ON f.page_id = u.page_id AND f.node < u.node LEFT JOIN tree s ON s.page_id = f.page_id AND s.node = f.parent
  WHERE u.kind IN {_IN(_USE)} AND f.kind IN {_IN(_DEFINE)} AND (s.node IS NULL OR s.last >= u.node) GROUP BY u.page_id, u.node)"""


def page_edges(nodes):
    """Edges of the pages' property graphs."""
    name = lambda kinds: F.when(F.col("kind").isin(*kinds), F.lit("block"))
    return trees.property_edges(nodes, "page_id", _BRANCHES, _LOOPS, _BLOCKS, name(_DEFINE), name(_USE))


@query(f"{_EDGES} SELECT * FROM edges")
def page_property_edges(spark, d):
    return page_edges(page_nodes(spark, d))


_KIND = {"body": "module", "article": "branch", "nav": "loop", "ul": "loop", "p": "block", "li": "block", "div": "block", "a": "call"}
_CASES = " ".join(f"WHEN '{k}' THEN {graph.NODE_KINDS.index(v)}" for k, v in _KIND.items())


@query(f"""{_EDGES}, e AS (SELECT page_id, src AS node, 1 AS o, 0 AS i, kind FROM edges UNION ALL SELECT page_id, dst, 0, 1, kind FROM edges),
d AS (SELECT page_id, node, sum(o) AS o, sum(i) AS i, max((kind LIKE 'cfg%')::INT) AS c, max((kind = 'def_use')::INT) AS f FROM e GROUP BY ALL)
SELECT page_id, node, CAST(CASE kind {_CASES} ELSE {graph.NODE_KINDS.index("literal")} END AS BIGINT) AS kind, round(depth / 20, 6) AS depth, round(coalesce(i, 0) / 20, 6) AS in_degree, round(coalesce(o, 0) / 20, 6) AS out_degree,
coalesce(c, 0)::DOUBLE AS has_cfg, coalesce(f, 0)::DOUBLE AS has_dfg, round(coalesce(i + o, 0) / (SELECT max(i + o) FROM d), 6) AS centrality FROM tree LEFT JOIN d USING (page_id, node)""")
def page_property_features(spark, d):
    """The 34 numbers of each element, from the edges that were built."""
    tree = page_nodes(spark, d)
    one = lambda c: F.concat_ws(":", "page_id", c)
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in _KIND.items() for x in (k, graph.NODE_KINDS.index(v)))), F.col("kind")), F.lit(graph.NODE_KINDS.index("literal")))
    nodes = tree.select(one("node").alias("node"), kind.alias("kind"), "depth", F.lit(1).alias("complexity"), F.lit(1).alias("loc"), F.lit(0).alias("params"), F.lit(False).alias("public"), F.lit(False).alias("documented"))
    group = F.when(F.col("kind").startswith("cfg"), "cfg").when(F.col("kind") == "def_use", "dfg").otherwise(F.col("kind"))
    edges = page_edges(tree).select(one("src").alias("src"), one("dst").alias("dst"), group.alias("kind"))
    at = lambda i: F.round(F.col("features")[i], 6)
    ids = F.split("node", ":")
    out = graph.property_features(nodes, edges)
    return out.select(ids[0].cast("long").alias("page_id"), ids[1].cast("int").alias("node"), (F.array_position(F.slice("features", 1, 18), F.lit(1.0)) - 1).alias("kind"), at(18).alias("depth"), at(26).alias("in_degree"), at(27).alias("out_degree"), at(29).alias("has_cfg"), at(30).alias("has_dfg"), at(33).alias("centrality"))


# a run for each kind of event and day; whoever has such an event that day is a finding
@query("""WITH f AS (SELECT DISTINCT event_type AS project, strftime(ts, '%Y-%m-%d') AS run_id, user_id FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT project, run_id, CAST(row_number() OVER (PARTITION BY project ORDER BY run_id) AS INT) AS nth FROM (SELECT DISTINCT project, run_id FROM f)),
x AS (SELECT f.*, nth FROM f JOIN r USING (project, run_id)),
n AS (SELECT a.project, a.nth, count(*) AS found, count(*) FILTER (NOT EXISTS (SELECT 1 FROM x b WHERE b.project = a.project AND b.nth = a.nth - 1 AND b.user_id IS NOT DISTINCT FROM a.user_id)) AS new FROM x a GROUP BY ALL),
g AS (SELECT a.project, a.nth + 1 AS nth, count(*) FILTER (NOT EXISTS (SELECT 1 FROM x b WHERE b.project = a.project AND b.nth = a.nth + 1 AND b.user_id IS NOT DISTINCT FROM a.user_id)) AS fixed FROM x a GROUP BY ALL)
SELECT project, run_id, r.nth, coalesce(found, 0) AS found, coalesce(new, 0) AS new, coalesce(fixed, 0) AS fixed FROM r LEFT JOIN n USING (project, nth) LEFT JOIN g USING (project, nth)""")
def run_history(spark, d):
    rows = table(spark, d, "events").filter("event_type IS NOT NULL AND ts IS NOT NULL")
    rows = rows.select(F.col("event_type").alias("project"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.to_date("ts").alias("started_at"), "user_id")
    return runs.history(rows, rows, ["user_id"])
