"""Rule packs over texts: findings, their roll-up, scores and verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import lines as text_lines
from .patterns import parse


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    severity: str = "warning"
    message: str = ""
    layer: str = "contract"
    domain: str = "general"
    language: str | None = None
    suggestion: str | None = None
    tags: tuple[str, ...] = field(default=())


def findings(texts: DataFrame, rules: Sequence[Rule], key: Sequence[str], text_col: str = "text", language_col: str | None = None) -> DataFrame:
    """One row per text and rule that holds: rule_id, layer, severity, message, count, lines, line (the first).

    Every rule is a literal expression over the row, so this is one narrow pass.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = texts.select(*key, *([language_col] if language_col else []), text.alias("_text"), text_lines(text).alias("_lines"))

    def one(r: Rule) -> Column:
        hits = parse(r.pattern).hits(F.col("_text"), F.col("_lines"))
        ok = F.size(hits) > 0
        if r.language and language_col:
            ok = (F.col(language_col) == r.language) & ok
        return F.when(ok, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.layer).alias("layer"), F.lit(r.severity).alias("severity"), F.lit(r.message or r.rule_id).alias("message"), hits.alias("hits")))

    if not rules:
        return base.select(*key, *(F.lit(None).cast(t).alias(n) for n, t in (("rule_id", "string"), ("layer", "string"), ("severity", "string"), ("message", "string"), ("count", "bigint"), ("lines", "array<int>"), ("line", "int")))).limit(0)
    found = base.select(*key, F.explode(F.filter(F.array(*map(one, rules)), lambda x: x.isNotNull())).alias("f"))
    count = F.aggregate("f.hits", F.lit(0).cast("bigint"), lambda s, h: s + h["n"])
    return found.select(*key, "f.rule_id", "f.layer", "f.severity", "f.message", count.alias("count"), F.transform("f.hits", lambda h: h["line"]).alias("lines"), F.element_at("f.hits", 1)["line"].alias("line"))


def deduplicated(violations: DataFrame, key: Sequence[str]) -> DataFrame:
    """Violations (rule_id, message, severity, line) of equal rule and message as one, with count, places and first line."""
    rows = violations.groupBy(*key, "rule_id", "message").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("line")).alias("lines"), F.min("line").alias("line"), F.min_by("severity", scores.severity_rank(F.col("severity"))).alias("severity"))
    return rows.withColumn("severity_rank", scores.severity_rank(F.col("severity")))


def severity_totals(found: DataFrame, key: Sequence[str], weight: str = "count") -> DataFrame:
    """A column for each severity, in one aggregate."""
    return found.groupBy(*key).agg(*(F.coalesce(F.sum(F.when(F.col("severity") == s, F.col(weight))), F.lit(0)).alias(f"n_{s}") for s in scores.SEVERITIES))


def layer_totals(found: DataFrame, layers: Sequence[str], weight: str = "count") -> DataFrame:
    """Findings and texts per layer; layers without any have zeros."""
    spark = found.sparkSession
    names = spark.createDataFrame([(x,) for x in layers], "layer string")
    totals = found.filter(F.col("layer").isin(*layers)).groupBy("layer").agg(F.sum(weight).alias("findings"), F.count(F.lit(1)).alias("hits"))
    return names.join(F.broadcast(totals), "layer", "left").select("layer", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("hits", F.lit(0)).alias("hits"))


def halted(found: DataFrame, order: Sequence[str], key: Sequence[str], gate: str = "syntax") -> DataFrame:
    """found without the layers after gate for texts with an error there: a failed gate ends the run."""
    stop = found.filter((F.col("layer") == gate) & F.col("severity").isin("critical", "error")).select(*key).distinct()
    later = [x for x in order[order.index(gate) + 1 :]]
    return found.filter(~F.col("layer").isin(*later)).unionByName(found.filter(F.col("layer").isin(*later)).join(stop, list(key), "left_anti"))


def verdicts(texts: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """A row per text: totals by severity, quality, score, and whether it passes (no critical or error)."""
    totals = found.withColumn("_penalty", scores.penalty(F.col("severity")) * F.col("count")).groupBy(*key).agg(*(F.sum(F.when(F.col("severity") == s, F.col("count")).otherwise(0)).alias(f"n_{s}") for s in scores.SEVERITIES), F.sum("_penalty").alias("_penalty"))
    rows = texts.select(*key).join(totals, list(key), "left").na.fill(0)
    errors = F.col("n_critical") + F.col("n_error")
    return rows.select(*key, *(f"n_{s}" for s in scores.SEVERITIES), F.round(scores.quality(errors, F.col("n_warning"), F.col("n_info")), 6).alias("quality"), F.round(scores.file_score(F.col("_penalty")), 6).alias("score"), (errors == 0).alias("passed"))


def whitelisted(found: DataFrame, whitelist: DataFrame, path_col: str, as_of: Column) -> DataFrame:
    """found with suppressed: an entry (rule_id, glob, expires_at or null) for its rule matches its path and is not over.

    The list is small by nature; Spark broadcasts it only if its size says so.
    """
    from ..functions.text import glob_column

    live = whitelist.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).select(F.col("rule_id").alias("_rule"), glob_column(F.col("glob")).alias("_glob"))
    hit = found.join(live, (F.col("rule_id") == F.col("_rule")) & F.expr(f"`{path_col}` rlike _glob"), "left_semi").select("rule_id", path_col).distinct()
    hit = hit.select(F.col("rule_id").alias("_r"), F.col(path_col).alias("_p"))
    return found.join(hit, (F.col("rule_id") == F.col("_r")) & (F.col(path_col) == F.col("_p")), "left").withColumn("suppressed", F.col("_r").isNotNull()).drop("_r", "_p")
