"""Connected and strongly connected components, with nothing but keyed joins.

Both end by themselves, however long paths are; every turn is saved, so plans stay short and lost executors cost a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, saved

#: Steps of a search back that one round takes, and edges that are left after trimming which are collected and walked in one place: as many at most.
STRIDE, FEW = 4, 1 << 16


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (ref, comp) after joining the components that links (a, b) connect.

    Every turn maps the links to components, points each component to its least
    neighbour if that is smaller, and follows pointers to their ends; components
    that still have neighbours at least halve. All is saved between turns.
    """
    comp = lambda x: labels.select(F.col("ref").alias(x), F.col("comp").alias(f"c{x}"))
    edges = saved(links.join(comp("a"), "a").join(comp("b"), "b").filter("ca <> cb").select("ca", "cb").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("cb", "ca"))
        up = saved(both.groupBy("ca").agg(F.min("cb").alias("m")).select(F.col("ca").alias("r"), F.least("ca", "m").alias("p")), "pointers")
        while True:  # pointers go down strictly, so they end; each turn halves their length
            over = up.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            jumped = saved(up.join(over, "p", "left").select("r", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "pointers")
            dropped(up)
            moved = not jumped.filter("moved").isEmpty()
            up = jumped.select("r", "p")
            if not moved:
                break
        if roots is None:
            roots = up
        else:
            later = up.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            roots = saved(roots.join(later, "p", "left").select("r", F.coalesce("pp", "p").alias("p")), "roots")
        to = lambda x: up.select(F.col("r").alias(x), F.col("p").alias(f"p{x}"))
        edges = saved(edges.join(to("ca"), "ca", "left").join(to("cb"), "cb", "left").select(F.coalesce("pca", "ca").alias("ca"), F.coalesce("pcb", "cb").alias("cb")).filter("ca <> cb").distinct(), "edges")
    if roots is None:
        return labels
    return saved(labels.join(roots.select(F.col("r").alias("comp"), F.col("p").alias("root")), "comp", "left").select("ref", F.coalesce("root", "comp").alias("comp")), "labels")


def connected(links: DataFrame) -> DataFrame:
    """(ref, comp) of every end of links (a, b): the least ref that it is connected with."""
    ends = links.select(F.col("a").alias("ref")).union(links.select("b")).distinct()
    return contract(saved(ends.select("ref", F.col("ref").alias("comp")), "ends"), links)


def trimmed(edges: DataFrame) -> DataFrame:
    """edges (src, dst) without those that are on no cycle for a plain reason: nothing leads to src, or nothing leads away from dst."""
    n = edges.count()
    while n:
        entered = edges.select(F.col("dst").alias("src")).distinct()
        left = edges.select(F.col("src").alias("dst")).distinct()
        fewer = saved(edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"), "trimmed")
        last, n = n, fewer.count()
        dropped(edges)
        edges = fewer
        if n > 0.95 * last:  # what is left goes by colours
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that leads to each node, itself included. Only nodes whose colour fell send it on."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    state = saved(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fell")), "colours")
    while not state.filter("fell").isEmpty():
        sent = state.filter("fell").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("got"))
        falls = F.coalesce(F.col("got") < F.col("colour"), F.lit(False))
        nxt = saved(state.drop("fell").join(sent, "node", "left").select("node", F.when(falls, F.col("got")).otherwise(F.col("colour")).alias("colour"), falls.alias("fell")), "colours")
        dropped(state)
        state = nxt
    return state.drop("fell")


def _walked(edges: list[tuple]) -> list[tuple]:
    """(node, least node of its component) for at most FEW edges: by order of leaving, then against the edges."""
    to, back = {}, {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    left, seen = [], set()
    for root in to.keys() | back.keys():
        stack = [] if root in seen else [(root, iter(to.get(root, ())))]
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                left.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(to.get(nxt, ()))))
    out, done = [], set()
    for root in reversed(left):
        if root in done:
            continue
        done.add(root)
        own = [root]
        for node in own:
            more = [x for x in back.get(node, ()) if x not in done]
            done.update(more)
            own += dict.fromkeys(more)
        least = min(own)
        out += [(x, least) for x in own]
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (src, dst): the least node of its strongly connected component.

    What is on no cycle is trimmed; then each node takes the least node that leads to it as its colour, and from every node that is its own
    colour a search goes back inside the colour: what it reaches is a component. The edges inside colours that are left go
    the same way, until none is; at most FEW edges are collected and walked in one place. Rounds follow the longest of the shortest paths, not the number of components.
    """
    nodes = saved(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    live = trimmed(saved(edges.filter("src <> dst").select("src", "dst").distinct(), "live"))
    found = None
    while not live.isEmpty():
        if live.count() <= FEW:
            kind = live.schema["src"].dataType.simpleString()
            own = live.sparkSession.createDataFrame(_walked([tuple(r) for r in live.select("src", "dst").collect()]), f"node {kind}, component {kind}")
            found = own if found is None else found.union(own)
            break
        colours = _colours(live)
        of = lambda x: colours.select(F.col("node").alias(x), F.col("colour").alias(f"c{x}"))  # noqa: B023, E731
        same = saved(live.join(of("src"), "src").join(of("dst"), "dst").filter("csrc = cdst").select("src", "dst"), "same")
        frontier = saved(colours.filter("node = colour"), "component")
        own = frontier
        while True:
            step, more = frontier, None
            for _ in range(STRIDE):
                step = same.join(step.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "colour").distinct()
                more = step if more is None else more.union(step)
            frontier = saved(more.distinct().join(own.select("node"), "node", "left_anti"), "component")
            if frontier.isEmpty():
                break
            own = own.union(frontier)
        own = saved(own.select("node", F.col("colour").alias("component")), "components")
        found = own if found is None else found.union(own)
        rest = same.join(own.select(F.col("node").alias("src")), "src", "left_anti").join(own.select(F.col("node").alias("dst")), "dst", "left_anti")
        live = trimmed(saved(rest.select("src", "dst"), "live"))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
