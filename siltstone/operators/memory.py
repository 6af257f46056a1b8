"""Entries of a memory, their recall and statistics, learned settings, exemptions in use, contracts and their import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import severity_rank
from ..session import saved


def recalled(entries: DataFrame, limit: int, order: Sequence[Column], **where) -> DataFrame:
    """The first limit entries (id) in an order, ties by id; where: columns with the values they must have."""
    for column, value in where.items():
        entries = entries.filter(F.col(column) == value)
    return entries.orderBy(*order, "id").limit(limit)


def by_type(entries: DataFrame, memory_type: str, limit: int) -> DataFrame:
    return recalled(entries, limit, [], memory_type=memory_type)


def by_project(entries: DataFrame, project: str, limit: int) -> DataFrame:
    return recalled(entries, limit, [], project=project)


def popular(entries: DataFrame, limit: int) -> DataFrame:
    """The most often recalled entries."""
    return recalled(entries, limit, [F.col("recall_count").desc()])


def recent(entries: DataFrame, limit: int) -> DataFrame:
    """The newest entries."""
    return recalled(entries, limit, [F.col("created_at").desc()])


def statistics(rows: DataFrame, facts: Sequence[str]) -> DataFrame:
    """(fact, value, n): the number of rows, and for each fact the rows of each of its values; one pass with grouping sets."""
    sets = rows.select(F.lit(1).alias("_one"), *(F.col(c).cast("string").alias(c) for c in facts))
    each = F.array(F.struct(F.lit("total").alias("fact"), F.lit("").alias("value")), *(F.struct(F.lit(c).alias("fact"), F.col(c).alias("value")) for c in facts))
    return sets.select(F.explode(each).alias("e")).groupBy("e.fact", "e.value").agg(F.count(F.lit(1)).alias("n"))


def completions(names: DataFrame, prefix: Column, limit: int, name_col: str = "name") -> DataFrame:
    """The first limit different names that begin with a prefix."""
    return names.filter(F.startswith(F.col(name_col), prefix)).select(name_col).distinct().orderBy(name_col).limit(limit)


def learned_config(runs: DataFrame, violations: DataFrame, accepted: DataFrame, key: Sequence[str], alpha: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """What validation runs teach: (key, samples, violation_rate) and the whitelist (key, rule_id, file).

    runs: (key, ts, id); violations: (key, run, violation, rule_id, file); accepted: (key, violation). The rate is the moving average of
    the violations of each run with weight alpha for the newest, from 0; an accepted violation puts its rule and file on the
    whitelist once.
    """
    key = list(key)
    n = violations.groupBy(*key, F.col("run").alias("id")).agg(F.count(F.lit(1)).alias("_v"))
    rows = runs.join(n, [*key, "id"], "left").select(*key, "ts", "id", F.coalesce("_v", F.lit(0)).cast("double").alias("_v"))
    age = F.row_number().over(W.partitionBy(*key).orderBy(F.col("ts").desc(), F.col("id").desc())) - 1
    rates = rows.withColumn("_age", age).groupBy(*key).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.pow(F.lit(1 - alpha), F.col("_age")) * alpha * F.col("_v")).alias("violation_rate"))
    white = violations.join(accepted.select(*key, "violation").distinct(), [*key, "violation"], "left_semi").select(*key, "rule_id", "file").distinct()
    return rates, white


def applied(exemptions: DataFrame, violations: DataFrame) -> DataFrame:
    """exemptions with applications and last_used: how many violations (exemption, ts) each accepted, and when last."""
    used = violations.filter(F.col("exemption").isNotNull()).groupBy(F.col("exemption").alias("id")).agg(F.count(F.lit(1)).alias("applications"), F.max("ts").alias("last_used"))
    return exemptions.join(used, "id", "left").withColumn("applications", F.coalesce("applications", F.lit(0)))


def revised(exemptions: DataFrame, created: DataFrame, removed: DataFrame) -> DataFrame:
    """exemptions after some are created or replaced (by id) and others removed."""
    kept = exemptions.join(created.select("id"), "id", "left_anti").unionByName(created)
    return kept.join(removed.select("id").distinct(), "id", "left_anti")


# Severities of the levels that linters and catalogues use.
LEVELS = {"clippy": {"correctness": "error", "suspicious": "warning", "perf": "warning", "style": "info", "complexity": "info", "pedantic": "hint"}, "eslint": {"2": "error", "1": "warning", "0": "hint"}, "pylint": {"F": "critical", "E": "error", "W": "warning", "R": "info", "C": "info"}, "cwe": {"High": "error", "Medium": "warning", "Low": "info"}, "owasp": {"critical": "critical", "high": "error", "medium": "warning", "low": "info"}}


def imported(records: DataFrame, least: str = "info", languages: Sequence[str] = (), domains: Sequence[str] = ()) -> DataFrame:
    """(rule_id, source, pattern, domain, severity, language, refs): records of linters and catalogues as rules.

    records: (source, code, level, pattern, domain, language, reference). Their levels become severities, what is less severe than least
    or of another language or domain goes, and of one pattern and domain the most severe stays with all references.
    """
    level = F.coalesce(*(F.when((F.col("source") == s) & (F.col("level") == k), F.lit(v)) for s, m in LEVELS.items() for k, v in m.items()), F.lit("warning"))
    rows = records.withColumn("severity", level).filter(severity_rank(F.col("severity")) <= severity_rank(F.lit(least)))
    if languages:
        rows = rows.filter(F.col("language").isin(*languages) | F.col("language").isNull())
    if domains:
        rows = rows.filter(F.col("domain").isin(*domains))
    rows = rows.withColumn("rule_id", F.concat(F.upper("source"), F.lit("-"), "code"))
    best = F.struct(severity_rank(F.col("severity")).alias("r"), F.col("rule_id").alias("i"))
    return rows.groupBy("pattern", "domain").agg(*(F.min_by(c, best).alias(c) for c in ("rule_id", "source", "severity", "language")), F.array_sort(F.collect_set("reference")).alias("refs"))


def generated_contracts(histogram: DataFrame, limits: dict[str, int], confident: float = 0.8) -> DataFrame:
    """(rule_id, rule_type, allowed, confidence, severity): a naming rule of each learned histogram (name, value, n).

    The commonest limits[name] values are allowed (ties by value); the confidence is their share, and a confident rule warns.
    """
    place = F.row_number().over(W.partitionBy("name").orderBy(F.col("n").desc(), "value"))
    most = F.coalesce(*(F.when(F.col("name") == k, F.lit(v)) for k, v in limits.items()))
    # a name has at most its limit of values after the window
    total = saved(histogram.groupBy("name").agg(F.sum("n").alias("_all")))
    rows = histogram.withColumn("_p", place).filter(F.col("_p") <= most)
    rows = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("_p", "value"))).alias("_v"), F.sum("n").alias("_n")).join(total, "name")
    share = F.col("_n") / F.col("_all")
    return rows.select(F.concat(F.lit("learned-"), "name").alias("rule_id"), F.col("name").alias("rule_type"), F.transform("_v", lambda v: v["value"]).alias("allowed"), share.alias("confidence"), F.when(share >= confident, "warning").otherwise("info").alias("severity"))


def run_totals(verdicts: DataFrame, found: DataFrame) -> DataFrame:
    """One row: files, passed, failed, findings, errors, warnings of a validation run over many files."""
    files = verdicts.select("passed", F.lit(None).cast("string").alias("severity"), F.lit(0).cast("long").alias("count"))
    both = files.unionByName(found.select(F.lit(None).cast("boolean").alias("passed"), "severity", F.col("count").cast("long").alias("count")))
    of = lambda *s: F.coalesce(F.sum(F.when(F.col("severity").isin(*s), F.col("count"))), F.lit(0))
    return both.agg(F.count("passed").alias("files"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.sum("count"), F.lit(0)).alias("findings"), of("critical", "error").alias("errors"), of("warning").alias("warnings"))


def parameters(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, functions, params, most): parameters of the functions that begin in lines (line, content)."""
    inside = F.regexp_extract("content", r"\b(?:fn|def|function|func)\s+\w+\s*\(([^)]*)", 1)
    names = F.filter(F.split(inside, ","), lambda p: (F.trim(p) != "") & ~F.trim(p).rlike(r"^(&?(mut )?self|self|cls)$"))
    defs = rows.filter(F.col("content").rlike(r"\b(?:fn|def|function|func)\s+\w+\s*\(")).select(*key, F.size(names).alias("_n"))
    return defs.groupBy(*key).agg(F.count(F.lit(1)).alias("functions"), F.sum("_n").alias("params"), F.max("_n").alias("most"))


def decision(rows: DataFrame) -> DataFrame:
    """rows (action, tier, confidence, rule_id) with decision: action, reason, tier, confidence and whether it may be overridden."""
    reason = F.when(F.col("action") == "block", F.concat(F.lit("inviolable rule "), "rule_id")).when(F.col("action") == "accept", F.lit("an exemption or a learned pattern")).when(F.col("action") == "learn", F.lit("seen often enough to learn")).when(F.col("action") == "ask", F.lit("not confident enough")).otherwise(F.lit("reported"))
    return rows.withColumn("decision", F.struct("action", reason.alias("reason"), "tier", F.col("confidence").cast("double").alias("confidence"), (F.col("action") != "block").alias("overridable")))
