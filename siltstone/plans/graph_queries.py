"""Queries of graphs: parts as nodes, with a tree of calls and some that lead elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, drift, graph
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def edges(spark, d):
    """Each part calls the one at half its number; large ones also call one further up, which makes cycles."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    n = p.count()
    tree = p.filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    far = p.filter("p_size > 45 AND p_partkey > 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 8 % (n + 1)).alias("dst"))
    return tree.union(far).filter("src <> dst AND dst > 0").distinct()


def tree(spark, d):
    return table(spark, d, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


def files(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("file"))


def starts(spark, d):
    return table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("node"))


_E = "WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey * 8 % ((SELECT count(*) FROM part) + 1) FROM part WHERE p_size > 45 AND p_partkey > 0) WHERE src <> dst AND dst > 0)"


def _reach(start: str, a: str, b: str, depth: int) -> str:
    return f"r AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part WHERE {start} UNION SELECT start, {b}, depth + 1 FROM r JOIN e ON node = {a} WHERE depth < {depth}), m AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node)"


@query(f"{_E} SELECT dst AS node, count(*) AS callers, min(src) AS first_caller FROM e GROUP BY dst")
def who_calls(spark, d):
    return graph.reverse(edges(spark, d)).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("callers"), F.min("dst").alias("first_caller"))


@query(f"{_E}, n AS (SELECT p_partkey AS id, 'f' || p_size || '::' || p_name AS node_id, p_name AS name FROM part), c AS (SELECT p_partkey AS src, CASE WHEN p_size % 2 = 0 THEN 'f' || p_size || '::' || p_name ELSE 'gone::' || p_name END AS ref FROM part), x AS (SELECT src, ref, id AS dst FROM c JOIN n ON ref = node_id), y AS (SELECT src, id AS dst FROM c JOIN n ON name = split_part(ref, '::', 2) WHERE ref NOT IN (SELECT node_id FROM n)) SELECT src, count(DISTINCT dst) AS targets FROM (SELECT src, dst FROM x UNION ALL SELECT src, dst FROM y) GROUP BY src")
def call_resolution(spark, d):
    p = table(spark, d, "part")
    full = F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit("::"), F.col("p_name"))
    nodes = p.select(full.alias("node_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("key"))
    calls = p.select(F.col("p_partkey").alias("src"), F.when(F.col("p_size") % 2 == 0, full).otherwise(F.concat(F.lit("gone::"), F.col("p_name"))).alias("ref"))
    # a reference is resolved once, whoever makes it; several nodes can have one full name: targets are counted by key
    refs = calls.select(F.col("ref").alias("src"), "ref").distinct()
    found = graph.resolve(nodes.select("node_id", "name").distinct(), refs)
    targets = found.join(nodes, found["dst"] == nodes["node_id"]).groupBy(F.col("src").alias("ref")).agg(F.countDistinct("key").alias("targets"))
    return calls.join(targets, "ref").select("src", "targets")


@query(f"{_E}, r AS (SELECT p_partkey AS start, p_partkey AS node FROM part WHERE p_partkey % 50 = 0 UNION SELECT start, src FROM r JOIN e ON node = dst), a AS (SELECT start AS node, count(*) - 1 AS affected FROM r GROUP BY start) SELECT node, affected, CASE WHEN affected > 10 THEN 'high' WHEN affected > 3 THEN 'medium' ELSE 'low' END AS risk FROM a")
def impact(spark, d):
    return graph.impact(edges(spark, d), starts(spark, d))


@query(f"{_E}, {_reach('p_partkey % 50 = 0', 'src', 'dst', 4)} SELECT start, node, depth FROM m WHERE depth > 0")
def deps_k(spark, d):
    return graph.reach(edges(spark, d), starts(spark, d), 4)


@query(f"{_E}, {_reach('p_partkey % 50 = 0', 'dst', 'src', 3)} SELECT start, node, depth FROM m WHERE depth > 0")
def dependents_k(spark, d):
    return graph.reach(graph.reverse(edges(spark, d)), starts(spark, d), 3)


@query(f"{_E}, p AS (SELECT p_partkey AS start, p_partkey AS node, [p_partkey] AS path FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT start, dst, list_append(path, dst) FROM p JOIN e ON node = src WHERE len(path) <= 60 AND NOT list_contains(path, dst)), b AS (SELECT start, node, min((len(path), path)) AS m FROM p WHERE len(path) > 1 GROUP BY start, node) SELECT start, node AS goal, array_to_string(m[2], '>') AS path FROM b WHERE node % 50 = 1")
def call_chain(spark, d):
    goals = table(spark, d, "part").filter("p_partkey % 50 = 1").select(F.col("p_partkey").alias("node"))
    out = graph.chains(edges(spark, d), starts(spark, d), goals)
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(f"{_E}, c AS (SELECT dst AS node, count(*) AS callers FROM e GROUP BY dst), o AS (SELECT src AS node, count(*) AS calls FROM e GROUP BY src), f AS (SELECT dst AS node, count(DISTINCT p_brand) AS files FROM e JOIN part ON src = p_partkey GROUP BY dst), r AS (SELECT p_partkey AS node, 2.0::DOUBLE * coalesce(callers, 0) + coalesce(calls, 0) + 1.5::DOUBLE * coalesce(files, 0) AS raw FROM part LEFT JOIN c ON c.node = p_partkey LEFT JOIN o ON o.node = p_partkey LEFT JOIN f ON f.node = p_partkey) SELECT node, raw, round(raw / (raw + 5), 6) AS score FROM r")
def context_score(spark, d):
    f = files(spark, d)
    return graph.context_score(f, edges(spark, d), f).withColumn("score", F.round("score", 6))


@query(f"{_E}, p AS (SELECT src AS start, dst AS node, [src, dst] AS path FROM e WHERE src < dst UNION ALL SELECT start, dst, list_append(path, dst) FROM p JOIN e ON node = src WHERE len(path) < 40 AND dst > start AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path FROM p JOIN e ON node = src AND dst = start")
def cycles(spark, d):
    return graph.cycles(edges(spark, d)).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""{_E}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM r JOIN e ON b = src)
SELECT n AS node, least(n, coalesce(min(b) FILTER (EXISTS (SELECT 1 FROM r s WHERE s.a = r.b AND s.b = r.a)), n)) AS component
FROM (SELECT src AS n FROM e UNION SELECT dst FROM e) LEFT JOIN r ON a = n GROUP BY n""")
def strong_components(spark, d):
    return components.strong_components(edges(spark, d))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1), s AS (SELECT DISTINCT dst AS node, 0 AS level FROM e WHERE dst NOT IN (SELECT src FROM e) UNION ALL SELECT src, level + 1 FROM s JOIN e ON node = dst) SELECT node, max(level) AS level FROM s GROUP BY node")
def topo_levels(spark, d):
    return graph.levels(tree(spark, d))


@query(f"{_E} SELECT src, dst, a.p_size // 17 AS src_layer, b.p_size // 17 AS dst_layer FROM e JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_size // 17 <> b.p_size // 17 AND NOT (a.p_size // 17 = 1 AND b.p_size // 17 = 0) AND NOT (a.p_size // 17 = 2 AND b.p_size // 17 = 1)")
def layer_violations(spark, d):
    layers = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.expr("p_size div 17").alias("layer"))
    return graph.layer_violations(edges(spark, d), layers, [(1, 0), (2, 1)])


@query(f"{_E}, {_reach('p_partkey % 50 = 0', 'src', 'dst', 3)}, n AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, node) AS n FROM m) SELECT start, node, depth FROM n WHERE n <= 50")
def expand_dependencies(spark, d):
    return graph.expand(edges(spark, d), starts(spark, d), 3, 50)


@query(f"{_E}, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT node, degree, round(degree / (SELECT max(degree) FROM g), 6) AS centrality FROM g")
def centrality(spark, d):
    return graph.centrality(edges(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query(f"{_E} SELECT a.p_brand AS src, b.p_brand AS dst, count(*) OVER (PARTITION BY a.p_brand) AS targets FROM e JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_brand <> b.p_brand GROUP BY a.p_brand, b.p_brand")
def file_dependencies(spark, d):
    from pyspark.sql import Window as W

    return graph.file_edges(edges(spark, d), files(spark, d)).withColumn("targets", F.count(F.lit(1)).over(W.partitionBy("src")))


@query(f"{_E}, {_reach('p_partkey % 50 = 0', 'src', 'dst', 3)}, s AS (SELECT m.*, p_retailprice / 10000 AS score FROM m JOIN part ON node = p_partkey) SELECT start, round(sum(score / (1 + depth)) / sum(1 / (1 + depth)), 6) AS weighted, arg_min(node, (-score, node)) AS worst, count_if(score > 0.15) AS concerning, count(*) AS files FROM s GROUP BY start")
def arch_drift(spark, d):
    s = starts(spark, d)
    rows = graph.reach(edges(spark, d), s, 3).unionByName(s.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")))
    scores = table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_retailprice") / 10000).alias("score"))
    out = drift.depth_weighted(rows.join(scores, "node"), ["start"])
    return out.select("start", F.round("weighted", 6).alias("weighted"), "worst", "concerning", "files")


@query("SELECT conv_id * 100000 + turn AS id, conv_id * 100000 + max(turn) OVER (PARTITION BY conv_id) AS latest, CAST(count(*) OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS INT) AS steps FROM conversations QUALIFY steps > 0")
def decision_latest(spark, d):
    from pyspark.sql import Window as W

    # chains are keyed by (conv_id, turn): the numbers of the report run into the next conversation's from turn 100,000 on
    c = table(spark, d, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("old"))
    links = c.withColumn("new", F.lead("old").over(W.partitionBy("conv_id").orderBy("turn"))).filter("new IS NOT NULL")
    number = lambda x: F.col(f"{x}.conv_id") * 100000 + F.col(f"{x}.turn")
    return graph.supersedes(links.select("old", "new")).select(number("id").alias("id"), number("latest").alias("latest"), F.col("steps").cast("int").alias("steps"))
