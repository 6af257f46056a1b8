"""Operators on tables of lines: metrics, neighbours, islands, depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import lines


def line_table(texts: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    """(key, line, content), one row per line from 1."""
    return texts.select(*key, F.posexplode(lines(F.col(text_col))).alias("_i", "content")).select(*key, (F.col("_i") + 1).alias("line"), "content")


def metrics(texts: DataFrame, key: Sequence[str], text_col: str = "text", comment: str = r"^\s*(//|#|--)", long: int = 120) -> DataFrame:
    """Lines, blank, comment and code lines, bytes of the longest line, and long lines: narrow, no explode."""
    ls = lines(F.col(text_col))
    n = lambda p: F.size(F.filter(F.col("_l"), p))
    rows = texts.select(*key, ls.alias("_l"))
    return rows.select(
        *key,
        F.size("_l").alias("n_lines"),
        n(lambda x: F.trim(x) == "").alias("blank"),
        n(lambda x: x.rlike(comment)).alias("comment"),
        n(lambda x: (F.trim(x) != "") & ~x.rlike(comment)).alias("code"),
        F.coalesce(F.array_max(F.transform("_l", lambda x: F.octet_length(x))), F.lit(0)).alias("longest"),
        n(lambda x: F.octet_length(x) > long).alias("long_lines"),
        n(lambda x: x.rlike(r"[ \t]$")).alias("trailing"),
    )


def near_lines(rows: DataFrame, key: Sequence[str], flag: Column, back: int, ahead: int) -> Column:
    """Whether flag holds in one of the lines around each line."""
    return F.max(flag.cast("int")).over(W.partitionBy(*key).orderBy("line").rowsBetween(-back, ahead)) == 1


def islands(rows: DataFrame, key: Sequence[str], flag: Column, longer_than: int) -> DataFrame:
    """(key, first_line, length) of runs of lines with flag that are longer than so many."""
    w = W.partitionBy(*key).orderBy("line")
    marked = rows.select(*key, "line", flag.alias("_f")).withColumn("_g", F.col("line") - F.sum(F.col("_f").cast("int")).over(w))
    return marked.filter("_f").groupBy(*key, "_g").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("length")).filter(F.col("length") > longer_than).drop("_g")


def depth(rows: DataFrame, key: Sequence[str], step: Column) -> DataFrame:
    """rows with depth: a running sum of step that never goes below 0."""
    w = W.partitionBy(*key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    run = rows.withColumn("_s", F.sum(step).over(w))
    return run.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def repeated(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines that stand more than once in their text: (key, content, n, first_line)."""
    return rows.filter(F.trim("content") != "").groupBy(*key, "content").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line")).filter("n > 1")


def balance(texts: DataFrame, key: Sequence[str], pairs: Sequence[tuple[str, str]] = (("(", ")"), ("[", "]"), ("{", "}")), text_col: str = "text") -> DataFrame:
    """For each kind of bracket: how many more open than close, and whether one closes before it opens."""
    rows = texts.select(*key, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    n = lambda x: F.length("_t") - F.length(F.replace("_t", F.lit(x)))
    open_, early = [n(a) - n(b) for a, b in pairs], []
    for a, b in pairs:
        step = lambda c: F.when(c == a, 1).when(c == b, -1).otherwise(0)  # noqa: B023, E731
        low = lambda s, c: F.struct((s["d"] + step(c)).alias("d"), F.least(s["m"], s["d"] + step(c)).alias("m"))  # noqa: B023, E731
        only = F.regexp_replace("_t", f"[^\\{a}\\{b}]+", "")
        # only a fold knows where brackets close before they open; pairs with nothing between them say nothing, and most texts have few others
        only = F.regexp_replace(F.regexp_replace(only, f"(\\{a}\\{b})+", ""), f"(\\{a}\\{b})+", "")
        early.append(F.when(only == "", False).otherwise(F.aggregate(F.split(only, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), low)["m"] < 0))
    unbalanced = F.greatest(*(F.abs(o) for o in open_)) > 0
    return rows.select(*key, sum(open_[1:], open_[0]).alias("unclosed"), F.greatest(*(e.cast("int") for e in early)).cast("boolean").alias("early_close"), unbalanced.alias("unbalanced"))
