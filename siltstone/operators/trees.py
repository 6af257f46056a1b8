"""Trees of nested elements as rows, and the edges of a property graph from such rows.

A tree is a table (key, node, parent, depth, last, kind): nodes are numbered in the order in which they begin, last is a number
that no node of the subtree exceeds and every later node outside of it does, and the top has depth 0 and no parent. Any
producer of such rows will do. All steps are windows over one partitioning by key: no joins, no rounds, and no Python.

Defined cases: a null text and one without elements have no rows; keys have to be unique, as rows of one key are one tree; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Comments, and elements whose content is not markup; the tag of an element, opening or closing.
COMMENTS, RAW, TAG = r"(?s)<!--.*?-->", r"(?is)(<(?:script|style)\b[^>]*>).*?(</(?:script|style)>)", r"</?[A-Za-z][A-Za-z0-9]*"

#: Bytes of the texts whose elements are one task's.
PART = 4 << 20

#: Names that a key may not have.
_NAMES = {"node", "parent", "depth", "last", "kind", "tag", "step", "sum", "low", "level", "whole", "at", "above", "asks", "e", "of", "own", "before", "nth", "src", "dst", "def", "use", "name", "made", "seen", "until"}


def _rows(*keys: str, order: str = "node"):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def _key(key: str) -> None:
    if key in _NAMES:
        raise ValueError(f"a key called {key} would be taken for a column of the tree; rename it")


def element_tree(texts: DataFrame, key: str, text_col: str = "html") -> DataFrame:
    """(key, node, parent, depth, last, kind) of the elements of marked-up texts.

    node and last are places of tags in the text, from 0. A closing tag ends the last open element of its name; one that finds none is
    skipped, and an element that is never closed (a line break, the html of a text that is cut off) holds nothing. A node's
    parent is the last closed element that began one level above it; elements that cross (<b><i></b></i>) are counted as
    they stand and not mended.
    """
    _key(key)
    # tags are shuffled as few bytes and sorted many times: parts are made by the texts, and Spark does not join them again
    parts = -(-(texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // PART) or 1
    plain = F.regexp_replace(F.regexp_replace(F.col(text_col), COMMENTS, ""), RAW, "$1$2")
    tags = texts.select(key, F.posexplode(F.regexp_extract_all(plain, F.lit(TAG), 0)).alias("node", "tag")).repartition(parts, key)
    step = F.when(F.col("tag").startswith("</"), -1).otherwise(1)
    rows = tags.select(key, "node", F.lower(F.translate("tag", "</", "")).alias("kind"), step.alias("step"))
    # levels of one name count from 0; below that, a closing tag has nothing to close
    named = _rows(key, "kind")
    rows = rows.withColumn("sum", F.sum("step").over(named))
    low = F.least(F.lit(0), F.coalesce(F.min("sum").over(named.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("low", low).filter("step = 1 OR sum >= low")
    rows = rows.withColumn("level", F.col("sum") - F.col("low") + F.when(F.col("step") == -1, 1).otherwise(0))
    level = W.partitionBy(key, "kind", "level").orderBy("node")
    rows = rows.withColumn("last", F.when(F.col("step") == 1, F.lead("node").over(level)))
    whole = F.when(F.col("step") == -1, -1).when(F.col("last").isNotNull(), 1).otherwise(0)
    open_ = F.coalesce(F.sum(whole).over(_rows(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nodes = rows.withColumn("depth", open_.cast("int")).filter("step = 1").withColumn("whole", F.col("last").isNotNull())
    # a node stands among those of its own depth, to which it may be the parent's level, and asks in the level above
    as_parent = F.struct(F.col("depth").alias("at"), F.when(F.col("whole"), F.col("node")).alias("above"), F.lit(False).alias("asks"))
    as_child = F.struct((F.col("depth") - 1).alias("at"), F.lit(None).cast("int").alias("above"), F.lit(True).alias("asks"))
    both = nodes.select(key, "node", "depth", F.coalesce("last", "node").alias("last"), "kind", F.explode(F.array(as_parent, as_child)).alias("e")).select("*", "e.*")
    both = both.withColumn("parent", F.last("above", ignorenulls=True).over(_rows(key, "at")))
    return both.filter("asks").select(key, "node", "parent", "depth", "last", "kind")


def property_edges(nodes: DataFrame, key: str, branches: Sequence[str] = (), loops: Sequence[str] = (), blocks: Sequence[str] = (), defines: Column | None = None, uses: Column | None = None) -> DataFrame:
    """(key, src, dst, kind) of the edges of each tree of nodes.

    ast: from a parent to each child. cfg_next: from a child to the next one. cfg_true and cfg_false: from a branch to the first
    and the second of its children that are blocks. cfg_back: from the first block of a loop back to the loop. def_use: to each
    node that uses a name from the node that defines it: the last one before it among those whose scope, the parent, is an ancestor of
    the user. defines and uses: the name that a node defines or uses, or null; a node may do both, and its own definition holds only after it.
    """
    _key(key)
    child = W.partitionBy(key, "parent").orderBy("node")
    block = F.col("kind").isin(*blocks)
    kids = nodes.filter("parent IS NOT NULL").withColumn("before", F.lag("node").over(child)).withColumn("nth", F.when(block, F.sum(block.cast("int")).over(child.rowsBetween(W.unboundedPreceding, W.currentRow))))
    # the kind of the parent comes from the parent's row: both are in the partition of the key
    of = nodes.select(key, F.col("node").alias("of"), "node", "kind", "last", F.lit(0).alias("own"), F.lit(None).cast("int").alias("before"), F.lit(None).cast("long").alias("nth"))
    of = of.unionByName(kids.select(key, F.col("parent").alias("of"), "node", "kind", "last", F.lit(1).alias("own"), "before", "nth"))
    first = F.first(F.when(F.col("own") == 0, F.col("kind")), ignorenulls=True).over(W.partitionBy(key, "of").orderBy("own", "node").rowsBetween(W.unboundedPreceding, W.currentRow))
    kids = of.withColumn("above", first).filter("own = 1")
    edge = lambda src, dst, kind, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind")))
    branch, loop = F.col("above").isin(*branches), F.col("above").isin(*loops)
    each = [edge("of", "node", "ast"), edge("before", "node", "cfg_next", F.col("before").isNotNull()), edge("of", "node", "cfg_true", branch & (F.col("nth") == 1))]
    each += [edge("of", "node", "cfg_false", branch & (F.col("nth") == 2)), edge("node", "of", "cfg_back", loop & (F.col("nth") == 1))]
    found = kids.select(key, F.explode(F.array(*each)).alias("e")).filter("e IS NOT NULL").select(key, "e.src", "e.dst", "e.kind")
    return found if defines is None or uses is None else found.unionByName(def_use(nodes, key, defines, uses))


def def_use(nodes: DataFrame, key: str, defines: Column, uses: Column) -> DataFrame:
    """(key, src, dst, kind = def_use): see property_edges.

    The key is one column with a name of its own. A use asks at each level above it, so rows grow with the depth of the trees and not with the definitions of a name.
    """
    _key(key)
    scope_end = F.max(F.when(F.col("own") == 0, F.col("last"))).over(W.partitionBy(key, "of"))
    base = nodes.select(key, "node", "parent", "depth", "last", defines.alias("def"), uses.alias("use"))
    # where the scope of a definition ends is the last of its parent; at the top it does not end
    ends = base.filter("def IS NOT NULL").select(key, F.col("parent").alias("of"), "node", "depth", "def", F.lit(None).cast("int").alias("last"), F.lit(1).alias("own"))
    ends = ends.unionByName(base.select(key, F.col("node").alias("of"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("def"), "last", F.lit(0).alias("own")))
    made = ends.withColumn("until", scope_end).filter("own = 1")
    until = F.when(F.col("of").isNull(), F.lit(2147483647)).otherwise(F.col("until"))
    made = made.select(key, F.col("def").alias("name"), F.col("depth").alias("at"), "node", F.struct(F.col("node").alias("node"), until.alias("until")).alias("made"))
    asked = base.filter("use IS NOT NULL").select(key, F.col("use").alias("name"), F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("at"), "node", F.lit(None).cast("struct<node:int,until:int>").alias("made"), F.lit(True).alias("asks"))
    both = made.withColumn("asks", F.lit(False)).unionByName(asked)
    before = W.partitionBy(key, "name", "at").orderBy("node").rangeBetween(W.unboundedPreceding, -1)
    seen = both.withColumn("seen", F.last("made", ignorenulls=True).over(before)).filter("asks AND seen.until >= node")
    return seen.groupBy(key, F.col("node").alias("dst")).agg(F.max("seen.node").alias("src")).select(key, "src", "dst", F.lit("def_use").alias("kind"))
