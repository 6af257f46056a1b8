"""Connected components by contraction, with nothing but keyed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


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
