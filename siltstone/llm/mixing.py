"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over its source's size. Within a
source they are prefix-summed in order of (size, id), one random offset is added to all
sums, and a document is emitted once for each integer that its interval crosses. Its
chance of a copy is therefore its expected copies, whatever its size, and a source's
taken words meet its target in expectation; in order of size they never miss it by more
than the source's largest document.

The prefix sums are global and distributed: rows are range-partitioned, numbered
inside their partition, and partition totals are added up per source. No source,
however large, is gathered in one task.

Defined cases: null text has size 0 and takes 0 words; the null source is a
source, ordered last; a source without words has target 0 and no copies; repeated rows are
separate documents, and of rows with one id, source and text the first by their other columns' hash get
their copies first; an empty table gives an empty result; texts of any length are one
number here; mix() returns the columns of its input whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, dropped, hashed_columns, packed, partitions, saved, unpacked

_POS_BITS = 33  # of monotonically_increasing_id()


def word_counts(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, raw): the number of words and a hash of each row's text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("raw"))


def _positions(df: DataFrame, *order: Column) -> DataFrame:
    """df in global order, saved, with _pid (its partition) and _pos (its place there)."""
    n = partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    mask = (1 << _POS_BITS) - 1
    return saved(placed.select(*df.columns, F.shiftrightunsigned("_id", _POS_BITS).alias("_pid"), F.col("_id").bitwiseAND(F.lit(mask)).alias("_pos")), "ordered")


def source_targets(sized: DataFrame, weights: Sequence[float], cap: float, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) for rows of (source, size).

    Sources in code point order (null last) weigh weights, repeating. They share
    share times all sizes by weight; what a source's target would have above cap
    times its size is shared again by weight until none is above.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = _positions(by_source, F.col("source").isNull(), F.col("source"))
    before = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_pid", (F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_before"))  # a row per partition
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("_before") + F.col("_pos"), F.lit(len(weights))) + 1).cast("int"))
    ranked = saved(placed.join(before, "_pid").select("source", "source_size", weight.alias("_w"), (F.col("source_size") * cap).alias("_cap")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, None
    while level != last:  # grows; each turn adds at least one capped source
        above = F.col("_w") * level > F.col("_cap")
        row = ranked.agg(F.sum(F.when(above, F.col("_cap"))).alias("c"), F.sum(F.when(~above, F.col("_w"))).alias("w")).first()
        last, level = level, (total * share - (row.c or 0.0)) / row.w if row.w else level
    dropped(placed)
    return ranked.select("source", "source_size", F.least(F.col("_w") * level, F.col("_cap")).alias("target"))


def offset(seed: int) -> Column:
    """The random offset, from 0 to 1, of each source for a seed."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source").cast("string"), F.lit("\0")))), 1, 8)
    return F.conv(head, 16, 10).cast("long") / float(1 << 32)


def crossed(nth: Column, rate: Column, offset: Column) -> Column:
    """Integers that the nth document's interval of the shifted prefix sums crosses."""
    return (F.floor(nth * rate + offset) - F.floor((nth - 1) * rate + offset)).cast("long")


def mixing_plan(sized: DataFrame, weights: Sequence[float], cap: float, seed: int = 0, share: float = 1.0) -> DataFrame:
    """(doc_id, source, raw, size, source_size, target, rate, offset, nth, copies) for rows of (doc_id, source, size, raw)."""
    sized = saved(sized.select("doc_id", "source", "size", "raw"), "sized")
    targets = source_targets(sized, weights, cap, share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("rate", rate).withColumn("offset", offset(seed)).withColumnRenamed("source", "_t")
    placed = _positions(sized, F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id"), F.col("raw"))
    runs = placed.groupBy("_pid", "source").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_pid").alias("_p"), F.col("source").alias("_s"), (earlier - F.col("_first")).alias("_shift"))
    runs = runs.join(targets, F.col("_s").eqNullSafe(F.col("_t")))
    rows = placed.join(runs, (F.col("_pid") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("nth", F.col("_pos") + F.col("_shift") + 1)
    return rows.select("doc_id", "source", "raw", "size", "source_size", "target", "rate", "offset", "nth", crossed(F.col("nth"), F.col("rate"), F.col("offset")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float], cap: float, seed: int = 0, share: float = 1.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    plan = mixing_plan(word_counts(docs, id_col, source_col, text_col), weights, cap, seed, share)
    # rows of one id, source and text are neighbours in the order: their first place and their number say all
    plan = plan.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("raw").alias("text_hash"))
    plan = plan.agg(F.min("nth").alias("first"), F.sum("copies").alias("all"), F.first("rate").alias("rate"), F.first("offset").alias("offset")).filter("all > 0")
    field = F.col("row").getField
    rows = packed(docs).withColumn("own_hash", F.xxhash64(field(text_col)))
    rows = rows.join(plan, field(id_col).eqNullSafe(F.col("id")) & field(source_col).eqNullSafe(F.col("of")) & (F.col("own_hash") == F.col("text_hash")))
    nth = F.row_number().over(W.partitionBy("id", "of", "text_hash").orderBy(hashed_columns(docs, text_col)))
    rows = rows.withColumn("n", crossed(F.col("first") + nth - 1, F.col("rate"), F.col("offset"))).filter("n > 0")
    return unpacked(rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))), docs.columns)
