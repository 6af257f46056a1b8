"""Duplicates of memory entries: equal content, near content, and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .parts import near, spaced


def exact_groups(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, first_id, copies) of contents that stand more than once; the digest stands for the content."""
    return rows.groupBy(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


#: Texts with copies up to which they may be sent to all tasks.
COPIED = 1 << 19


def near_pairs(rows: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(a, b, score), a < b: entries of different content whose word sets have this Jaccard likeness or more.

    Equal contents are one entry (the least id). Sets meet by the parts that alike ones must have equal (parts.py); only those that meet are read
    again and compared, in the squares of their groups. Texts are read several times and not moved, so rows must be files or another deterministic scan.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("digest", F.unhex(F.sha2("_t", 256)))
    copied = saved(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "copied")
    copied = F.broadcast(copied) if copied.count() <= COPIED else copied
    one = rows.join(copied, "digest", "left").filter("id IS NOT NULL AND (first IS NULL OR id = first)")
    if one.select("id", "digest").distinct().groupBy("id").count().filter("count > 1").isEmpty():
        return near(one.select("id", spaced(F.col("_t")).alias("words")), threshold)
    # an id of several texts: they are told apart by their digests
    found = near(one.select(F.hex("digest").alias("id"), spaced(F.col("_t")).alias("words")), threshold)
    of = lambda x: one.select(F.hex("digest").alias(x), F.col("id").alias(f"i{x}")).distinct()
    return found.join(of("a"), "a").join(of("b"), "b").filter("ia <> ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "score")


def merged(entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entries (id, created_at, recall_count, errors, helpful) of one key as one: the newer's id, the most recalls,
    the earliest date, all errors, and the newest feedback there is."""
    return entries.groupBy(*key).agg(
        F.max_by("id", F.struct("created_at", "id")).alias("id"),
        F.max("recall_count").alias("recall_count"),
        F.min("created_at").alias("created_at"),
        F.max_by("helpful", F.when(F.col("helpful").isNotNull(), F.struct("created_at", "id"))).alias("helpful"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("errors", F.array().cast("array<string>")))))).alias("errors"),
        F.count(F.lit(1)).alias("merged"),
    )


def report(groups: DataFrame, bytes_each: int = 500) -> DataFrame:
    """Groups, entries to remove, pairs, and bytes that merging saves."""
    n = F.col("copies")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("removable"), F.coalesce(F.sum((n * (n - 1) / 2).cast("bigint")), F.lit(0)).alias("pairs"), F.coalesce(F.sum((n - 1) * bytes_each), F.lit(0)).alias("saved_bytes"))
