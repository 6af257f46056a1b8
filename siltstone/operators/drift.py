"""Metric snapshots over time: trends, drift, alerts, roll-ups along dependencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Metrics with their weights, and those of which less is better.
WEIGHTS = {"type_strictness": 0.25, "naming_consistency": 0.15, "error_handling": 0.25, "complexity": 0.2, "dead_code": 0.15}
INVERSE = ("complexity", "dead_code")
SEVERITY_FACTOR = {"high": 2.0, "medium": 1.5, "low": 1.0}


def long_form(snapshots: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(key, ts, metric, value)."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return snapshots.select(*key, "ts", F.explode(each).alias("m")).select(*key, "ts", "m.metric", "m.value")


def trends(snapshots: DataFrame, key: Sequence[str], metrics: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """(key, metric, first, last, delta, direction, severity): the first against the last snapshot; one aggregate.

    Changes under 0.02 are stable. direction is of the quality: a metric of which
    less is better improves when it falls.
    """
    rows = long_form(snapshots, key, metrics).groupBy(*key, "metric").agg(F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"), F.count(F.lit(1)).alias("n"))
    delta = F.col("last") - F.col("first")
    gain = F.when(F.col("metric").isin(*INVERSE), -delta).otherwise(delta)
    size = F.abs(delta)
    rows = rows.withColumn("delta", delta).withColumn("direction", F.when(size < 0.02, "stable").when(gain > 0, "improving").otherwise("declining"))
    return rows.withColumn("severity", F.when(size > 0.1, "high").when(size > 0.05, "medium").otherwise("low"))


def drift_score(trend: DataFrame, key: Sequence[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(key, score): sizes of declines, weighted by metric and severity, at most 1; added in the order of weights, so that runs agree to the last bit."""
    w = F.coalesce(*(F.when(F.col("metric") == m, F.lit(x)) for m, x in weights.items()), F.lit(0.0))
    f = F.coalesce(*(F.when(F.col("severity") == s, F.lit(x)) for s, x in SEVERITY_FACTOR.items()))
    part = F.when(F.col("direction") == "declining", F.abs("delta") * w * f).otherwise(0.0)
    # a sum for each metric has one term, whatever the order of rows
    sums = [F.coalesce(F.sum(F.when(F.col("metric") == m, part)), F.lit(0.0)) for m in weights]
    total = sum(sums[1:], sums[0])
    return trend.groupBy(*key).agg(F.least(F.lit(1.0), total).alias("score"), F.max("n").alias("snapshots"))


# What a decline of each severity adds to the flat score.
FLAT = {"high": 0.3, "medium": 0.15, "low": 0.05}


def flat_score(trend: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, score): declines by severity alone, at most 1."""
    part = F.coalesce(*(F.when((F.col("direction") == "declining") & (F.col("severity") == s), F.lit(x)) for s, x in FLAT.items()), F.lit(0.0))
    return trend.groupBy(*key).agg(F.least(F.lit(1.0), F.sum(part)).alias("score"))


def report(scores: DataFrame, key: str, k: int) -> DataFrame:
    """The k files that drift most, with their places; ties by key."""
    best = scores.orderBy(F.round("score", 9).desc(), key).limit(k)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.round("score", 9).desc(), key)))  # k rows


def alerts(scores: DataFrame, least: int = 3) -> DataFrame:
    """Scores of enough snapshots with their level: from 0.30 critical, from 0.15 warning."""
    level = F.when(F.col("score") >= 0.30, "critical").when(F.col("score") >= 0.15, "warning")
    return scores.filter(F.col("snapshots") >= least).withColumn("level", level).filter(F.col("level").isNotNull())


def last_n(snapshots: DataFrame, key: Sequence[str], n: int = 100) -> DataFrame:
    """The newest n snapshots of each key."""
    w = W.partitionBy(*key).orderBy(F.col("ts").desc(), *[F.col(c) for c in snapshots.columns if c not in (*key, "ts")])
    return snapshots.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def look_back(snapshots: DataFrame, as_of: Column, days: int) -> DataFrame:
    return snapshots.filter((F.col("ts") > as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("ts") <= as_of))


def depth_weighted(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean of score weighted by 1 / (1 + depth), the worst file, and how many are over 0.15."""
    w = F.lit(1.0) / (F.col("depth") + 1)
    return rows.groupBy(*key).agg((F.sum(F.col("score") * w) / F.sum(w)).alias("weighted"), F.min_by("node", F.struct((-F.col("score")).alias("s"), F.col("node").alias("n"))).alias("worst"), F.count_if(F.col("score") > 0.15).alias("concerning"), F.count(F.lit(1)).alias("files")).withColumn("advice", F.when(F.col("weighted") >= 0.25, "act").when(F.col("weighted") >= 0.15, "plan").when(F.col("weighted") >= 0.08, "watch").otherwise("none"))


def anomalies(features: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, kind, severity, value): cyclomatic over 15 (3), nesting over 4 (2), unwraps over 5 (4)."""
    rules = [("cyclomatic", 15, 3), ("nesting", 4, 2), ("unwraps", 5, 4)]
    each = F.array(*(F.when(F.col(c) > limit, F.struct(F.lit(c).alias("kind"), F.lit(s).alias("severity"), F.col(c).cast("bigint").alias("value"))) for c, limit, s in rules))
    return features.select(*key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("a")).select(*key, "a.*")


def quality_metrics(features: DataFrame, key: Sequence[str]) -> DataFrame:
    """Snapshot metrics of feature counts: error handling 1 - unwraps / 10, complexity cyclomatic / 20, both from 0 to 1."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return features.select(*key, unit(1 - F.col("unwraps") / 10).alias("error_handling"), unit(F.col("cyclomatic") / 20).alias("complexity"), F.when(F.col("documented"), 0.5).otherwise(0.0).alias("documentation"))


def ema(rows: DataFrame, key: Sequence[str], value: str, alpha: float = 0.1, start: float = 0.0) -> DataFrame:
    """(key, ema): values folded in order of ts, id; powers of (1 - alpha) by place make it one aggregate.

    ema = start (1-a)^n + sum of a (1-a)^(n-i) v_i, so only places are needed, not a fold over one task's rows.
    """
    w = W.partitionBy(*key).orderBy(F.col("ts").desc(), F.col("id").desc())
    rows = rows.select(*key, F.col(value).cast("double").alias("_v"), (F.row_number().over(w) - 1).alias("_age"))
    keep = 1 - alpha
    return rows.groupBy(*key).agg((F.pow(F.lit(keep), F.count(F.lit(1))) * start + F.sum(F.pow(F.lit(keep), F.col("_age")) * F.col("_v") * alpha)).alias("ema"))
