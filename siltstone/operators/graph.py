"""Graphs of calls and dependencies: resolution, reach, chains, cycles, levels, layers.

Traversals are rounds of a frontier joined to the edges. A node joins the result in
the first round that reaches it, so work is bounded by the edges times one, cycles
end by themselves, and depths are least depths. Each round is saved, which bounds
the plan and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import dropped as _dropped
from ..session import saved as _saved
from .components import strong_components


def resolve(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst) of calls (src, ref): by exact id, else every node whose name is the last part of the reference."""
    exact = calls.join(nodes.select(F.col("node_id").alias("ref"), F.col("node_id").alias("dst")), "ref")
    rest = calls.join(nodes.select(F.col("node_id").alias("ref")), "ref", "left_anti")
    named = rest.withColumn("name", F.element_at(F.split("ref", "::"), -1)).join(nodes.select("name", F.col("node_id").alias("dst")), "name")
    return exact.select("src", "dst").unionByName(named.select("src", "dst")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, calls, callers)."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("calls"), F.sum("i").alias("callers"))


def _rounds(max_depth: int | None):
    return count(1) if max_depth is None else range(1, max_depth + 1)


#: Rounds after which what was seen is written as one table, so that a round reads few.
_COMPACT = 8


def _with(seen: DataFrame, more: DataFrame, r: int) -> DataFrame:
    seen = seen.unionByName(more)
    return _saved(seen, "seen") if r % _COMPACT == 0 else seen


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): what each start reaches along edges, and the fewest steps; at most max_depth unless None.

    Files of numbers are much smaller than their rows, so no round leaves it to their size whether it sends a side to the driver.
    """
    e = _saved(edges.select("src", "dst").distinct(), "edges")
    seen = _saved(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)), "starts")
    frontier = seen
    for d in _rounds(max_depth):
        nxt = frontier.join(e.hint("merge"), frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = _saved(nxt.join(seen.select("start", "node").hint("merge"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = _with(seen, frontier, d)
    return seen.filter("depth > 0")


def impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, affected, risk): all transitive callers of each start; over 10 high, over 3 medium."""
    n = reach(reverse(edges), starts).groupBy(F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("affected"))
    rows = starts.select("node").distinct().join(n.hint("merge"), "node", "left").select("node", F.coalesce("affected", F.lit(0)).alias("affected"))
    return rows.withColumn("risk", F.when(F.col("affected") > 10, "high").when(F.col("affected") > 3, "medium").otherwise("low"))


#: Steps of a search without depths that one round takes.
_STRIDE = 4


def leading_to(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(node): goals (node), and what reaches one."""
    own = frontier = _saved(goals.select("node").distinct(), "goals")
    for r in count(1):
        step, more = frontier, None
        for _ in range(_STRIDE):
            step = edges.join(step.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
            more = step if more is None else more.union(step)
        frontier = _saved(more.distinct().join(own, "node", "left_anti"), "back")
        if frontier.isEmpty():
            break
        own = _with(own, frontier, r)
    return own


#: Rows of a frontier up to which it is sent to all tasks (some 12 MB), so that a round shuffles neither the edges nor all that was seen.
_SENT = 1 << 18


def chains(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, goal, path): one shortest path each (the least by node names); of any length if max_depth is None.

    A search back from all goals leaves the edges that can lead to one. The search from the starts keeps a row for each node it
    visits: its predecessor, and its rank among the nodes of its depth, which orders their least paths. The
    paths of the goals are rebuilt from these pointers, one depth after the other.
    """
    e = _saved(edges.select("src", "dst").distinct(), "edges")
    useful = leading_to(e, goals)
    e = _saved(e.join(useful.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "edges")
    # a start that leads to no goal has no chain
    firsts = starts.select("node").distinct().join(useful, "node", "left_semi")
    frontier = _saved(firsts.select(F.col("node").alias("start"), "node", F.lit(1).alias("rank")), "frontier")
    seen, depths, rows = frontier.select("start", "node"), [], frontier.count()
    for d in _rounds(max_depth):
        sent, known = frontier.hint("merge"), seen
        if rows <= _SENT:  # late rounds are many and have few starts
            sent, known = F.broadcast(frontier), seen.join(F.broadcast(frontier.select("start").distinct()), "start", "left_semi")
        nxt = e.join(sent, e["src"] == sent["node"]).groupBy("start", F.col("dst")).agg(F.min(F.struct("rank", F.col("node").alias("pred"))).alias("by"))
        nxt = nxt.select("start", F.col("dst").alias("node"), "by").join(known.hint("merge"), ["start", "node"], "left_anti")
        order = W.partitionBy("start").orderBy("by.rank", "node")
        frontier = _saved(nxt.select("start", "node", F.col("by.pred").alias("pred"), F.row_number().over(order).alias("rank")), "frontier")
        rows = frontier.count()
        if not rows:
            break
        depths.append(frontier)
        seen = _with(seen, frontier.select("start", "node"), d)
    ends = goals.select("node").distinct()
    open_ = None  # (start, goal, node, path): paths of goals, from their end back to node
    for n, at in enumerate(reversed(depths), 1):
        own = at.join(ends, "node", "left_semi").select("start", F.col("node").alias("goal"), "node", F.array("node").alias("path"))
        open_ = own if open_ is None else open_.union(own)
        step = open_.join(at.select("start", "node", "pred"), ["start", "node"])
        open_ = step.select("start", "goal", F.col("pred").alias("node"), F.concat(F.array("pred"), "path").alias("path"))
        open_ = _saved(open_, "paths") if n % 4 == 0 else open_
    if open_ is None:
        return seen.filter("false").select("start", F.col("node").alias("goal"), F.array("node").alias("path"))
    return open_.select("start", "goal", "path")


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """(path): every cycle, from its least node; of at most max_length different nodes unless None.

    A cycle stays inside a strongly connected component, so only the edges inside components are walked: where there is no cycle,
    no path is listed. Paths only pass nodes above their start, so each cycle is found once.
    """
    loops = edges.filter("src = dst").select("src").distinct().select(F.array("src").alias("path"))
    e = _saved(edges.filter("src <> dst").select("src", "dst").distinct(), "edges")
    parts = strong_components(e)
    of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    e = _saved(e.join(of("src"), "src").join(of("dst"), "dst").filter("csrc = cdst").select("src", "dst"), "edges")
    paths = e.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("path"))
    found = [loops]
    for _ in _rounds(None if max_length is None else max_length - 1):
        if paths.isEmpty():
            break
        step = _saved(paths.join(e, paths["node"] == e["src"]).select("start", F.col("dst").alias("node"), "path"))
        found.append(step.filter("start = node").select("path"))
        paths = step.filter("node > start").filter(~F.array_contains("path", F.col("node"))).select("start", "node", F.concat("path", F.array("node")).alias("path"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path to a node without successors; nodes in or before a cycle have null.

    Each round a node without a level counts its successors that got one in the last round; its own is due when none
    is left. Rounds end when none gives a level: with the longest path, however long that is.
    """
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("node"), F.lit(1).alias("n")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("n")))
    # left: successors without a level
    open_ = _saved(nodes.groupBy("node").agg(F.sum("n").alias("left")))
    done = []
    for r in count():
        ready = _saved(open_.filter("left = 0").select("node", F.lit(r).alias("level")))
        if ready.isEmpty():
            break
        done.append(ready)
        fewer = e.join(ready.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_k"))
        last = open_
        open_ = _saved(open_.filter("left > 0").join(fewer, "node", "left").select("node", (F.col("left") - F.coalesce("_k", F.lit(0))).alias("left")))
        _dropped(last)
    out = open_.select("node", F.lit(None).cast("int").alias("level"))
    for f in done:
        out = out.unionByName(f)
    return out


def context_score(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(node, raw, score): twice the callers, the calls, and 1.5 for each file of callers; raw / (raw + 5)."""
    d = degrees(edges)
    spread = edges.join(files.select(F.col("node").alias("src"), "file"), "src").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("file").alias("files"))
    rows = nodes.select("node").join(d, "node", "left").join(spread, "node", "left").na.fill(0)
    raw = F.col("callers") * 2.0 + F.col("calls") + F.col("files") * 1.5
    return rows.select("node", raw.alias("raw"), (raw / (raw + 5)).alias("score"))


def file_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): which file depends on which other."""
    f = lambda x: files.select(F.col("node").alias(x), F.col("file").alias(f"f{x}"))
    return edges.join(f("src"), "src").join(f("dst"), "dst").filter("fsrc <> fdst").select(F.col("fsrc").alias("src"), F.col("fdst").alias("dst")).distinct()


def layer_violations(edges: DataFrame, layers: DataFrame, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """(src, dst, src_layer, dst_layer) of edges between different layers that are not allowed."""
    of = lambda x: layers.select(F.col("node").alias(x), F.col("layer").alias(f"{x}_layer"))
    rows = edges.join(of("src"), "src").join(of("dst"), "dst").filter("src_layer <> dst_layer")
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("src_layer") == a) & (F.col("dst_layer") == b))
    return rows.filter(~ok).select("src", "dst", "src_layer", "dst_layer")


def expand(edges: DataFrame, starts: DataFrame, max_depth: int = 3, max_files: int = 50) -> DataFrame:
    """(start, node, depth) of the first max_files by depth and name, the start included: a feature of the report."""
    rows = reach(edges, starts, max_depth).unionByName(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("start").orderBy("depth", "node"))).filter(F.col("_n") <= max_files).drop("_n")


def centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): degree over the largest."""
    d = degrees(edges).select("node", (F.col("calls") + F.col("callers")).alias("degree"))
    most = d.agg(F.max("degree").alias("most"))
    return d.join(F.broadcast(most)).select("node", "degree", (F.col("degree") / F.col("most")).alias("centrality"))


# Places of kinds of nodes in a feature vector.
NODE_KINDS = ["function", "method", "variable", "parameter", "return", "literal", "binary_op", "unary_op", "call", "branch", "loop", "struct", "enum", "trait", "impl", "field", "module", "block"]


def property_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, features): 34 numbers for each node of a property graph.

    nodes: (node, kind: a place in NODE_KINDS, depth, complexity, loc, params, public, documented); edges: (src, dst,
    kind: ast, cfg, dfg or call). 0 to 17 are the kind, 18 depth / 20, 19 complexity / 10, 20 loc / 100, 21 parameters / 10, 22 public,
    23 documented, 24 whether it calls, 25 whether it is called, 26 and 27 degrees in and out / 20, 28 degree / 40,
    29 to 31 whether it has edges of control, of data and of calls, 32 whether it calls and is not called by anything, 33 degree over the largest.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "kind").unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "kind"))
    has = lambda k: F.max((F.col("kind") == k).cast("double"))
    call = F.col("kind") == "call"
    d = ends.groupBy("node").agg(F.sum("o").alias("_o"), F.sum("i").alias("_i"), has("cfg").alias("_c"), has("dfg").alias("_d"), has("call").alias("_l"), F.max(F.when(call, F.col("o")).otherwise(0)).alias("_calls"), F.max(F.when(call, F.col("i")).otherwise(0)).alias("_called"))
    d = _saved(d)
    most = d.agg(F.max(F.col("_o") + F.col("_i"))).first()[0] or 1
    rows = nodes.join(d, "node", "left").na.fill(0, ["_o", "_i", "_c", "_d", "_l", "_calls", "_called"])
    one = lambda c: F.col(c).cast("double")
    total = one("_o") + one("_i")
    kinds = [(F.col("kind") == i).cast("double") for i in range(len(NODE_KINDS))]
    own = [one("depth") / 20, one("complexity") / 10, one("loc") / 100, one("params") / 10, one("public"), one("documented"), one("_calls"), one("_called")]
    of_graph = [one("_i") / 20, one("_o") / 20, total / 40, one("_c"), one("_d"), one("_l"), ((F.col("_i") == 0) & (F.col("_o") > 0)).cast("double"), total / float(most)]
    return rows.select("node", F.array(*kinds, *own, *of_graph).alias("features"))


def supersedes(links: DataFrame) -> DataFrame:
    """(id, latest, steps): the end of each chain of (old, new) links, by doubling of the pointers.

    A chain has no more steps than there are links: what still moves then is in or before a circle and has null.
    """
    up = _saved(links.select(F.col("old").alias("id"), F.col("new").alias("latest"), F.lit(1).cast("long").alias("steps")))
    most, done = up.count(), 1
    while True:
        nxt = up.select(F.col("id").alias("latest"), F.col("latest").alias("_l"), F.col("steps").alias("_s"))
        step = _saved(up.join(nxt, "latest", "left").select("id", F.coalesce("_l", "latest").alias("latest"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.col("_l").isNotNull().alias("_more")))
        if step.filter("_more").isEmpty():
            return step.drop("_more")
        if done > most:
            return step.select("id", *(F.when(~F.col("_more"), F.col(c)).alias(c) for c in ("latest", "steps")))
        up = step.drop("_more")
        done *= 2


def full_context(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, direction, depth, nodes): callers and calls of each start by depth."""
    def side(e: DataFrame, name: str) -> DataFrame:
        return reach(e, starts, max_depth).groupBy("start", "depth").agg(F.array_sort(F.collect_set("node")).alias("nodes")).withColumn("direction", F.lit(name))

    return side(edges, "calls").unionByName(side(reverse(edges), "callers")).select("start", "direction", "depth", "nodes")


def entry_points(edges: DataFrame) -> DataFrame:
    """(node): nodes that call and are not called."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def ancestors(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, node_id, kinds): the kinds from the root of a flattened tree down to each node (kind, parent_id, depth).

    A level is joined to the one above it, so there are as many joins as levels; a tree may have any depth.
    """
    level = nodes.filter("depth = 0").select(*key, "node_id", F.array("kind").alias("kinds"))
    out = level
    for d in count(1):
        here = nodes.filter(F.col("depth") == d)
        above = level.select(*key, F.col("node_id").alias("parent_id"), F.col("kinds").alias("_k"))
        level = _saved(here.join(above, [*key, "parent_id"]).select(*key, "node_id", F.concat("_k", F.array("kind")).alias("kinds")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
