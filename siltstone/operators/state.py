"""Stateful decisions in batch: deltas, exemptions, learning, compliance, tiers, pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import saved

# Rules and words of rule domains by compliance tier.
TIER_RULES = {"inviolable": ["SEC001", "SEC002", "SUPP001"], "strict": ["LOGIC001", "ARCH001"]}
TIER_WORDS = {"inviolable": ["secur", "supply", "crypto"], "strict": ["logic", "memory", "architect", "concurr"]}


def file_delta(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(path, change): added, removed, modified or unchanged; one full join on the key."""
    o, n = old.select(F.col(key), F.col(digest).alias("_o")), new.select(F.col(key), F.col(digest).alias("_n"))
    return o.join(n, key, "full_outer").select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified").otherwise("unchanged").alias("change"))


def violation_delta(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, status): new, fixed or persistent."""
    o, n = old.select(*key).distinct().withColumn("_o", F.lit(1)), new.select(*key).distinct().withColumn("_n", F.lit(1))
    return o.join(n, list(key), "full_outer").select(*key, F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "fixed").otherwise("persistent").alias("status"))


def accepted(violations: DataFrame, acceptances: DataFrame, key: Sequence[str], as_of: Column) -> DataFrame:
    """violations with accepted: an acceptance of the same key that has not expired."""
    live = acceptances.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).select(*key).distinct().withColumn("_a", F.lit(True))
    return violations.join(live, list(key), "left").withColumn("accepted", F.coalesce("_a", F.lit(False))).drop("_a")


def tier(rule: Column, domain: Column) -> Column:
    """By rule first, then by a word in the domain; else flexible."""
    out = F.when(F.lit(False), "flexible")
    for name, rules in TIER_RULES.items():
        out = out.when(rule.isin(*rules), name)
    for name, words in TIER_WORDS.items():
        out = out.when(F.lower(domain).rlike("|".join(words)), name)
    return out.otherwise("flexible")


def exempted(violations: DataFrame, exemptions: DataFrame) -> DataFrame:
    """violations (rule_id, path) with the first exemption (ordinal) whose scope has them: file, dir, glob or project.

    A scope is filed under the folder or file that it names, a glob under what stands before its first wildcard; a path asks itself, each folder
    above it, and its beginnings of those lengths that globs have: an equi-join, in which a rule with very many exemptions shows a path those alone that begin as it does.
    """
    from ..functions.text import glob_column

    value = F.coalesce(F.col("scope_value"), F.lit(""))
    of = F.when(F.col("scope_kind") == "project", "p:").when(F.col("scope_kind") == "file", F.concat(F.lit("f:"), value)).when(F.col("scope_kind") == "dir", F.concat(F.lit("d:"), F.rtrim(value)))
    of = of.when((F.col("scope_kind") == "glob") & ~value.rlike("[*?]"), F.concat(F.lit("f:"), value)).when(F.col("scope_kind") == "glob", F.concat(F.lit("g:"), F.regexp_extract(value, "^[^*?]*", 0)))
    glob = F.when(F.col("scope_kind") == "glob", glob_column(value))
    e = exemptions.select(F.col("rule_id").alias("_r"), of.alias("_of"), glob.alias("_g"), "ordinal", F.col("id").alias("exemption"))
    e = saved(e, "exemptions")  # its size is known then, also where it was exploded
    kind = F.substring("_of", 1, 2)
    kinds = e.select(kind.alias("kind"), F.when(kind == "g:", F.length("_of") - 2).alias("n")).filter("kind IS NOT NULL").distinct().collect()  # the kinds, and no more lengths than the longest glob has
    lengths = F.array(*(F.lit(r.n) for r in kinds if r.n is not None)).cast("array<int>")
    paths = violations.select("rule_id", "path").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    named = lambda kind: F.transform(above, lambda x: F.concat(F.lit(kind), x))
    begins = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.concat(F.lit("g:"), F.left("path", n)))
    asks = {"p:": F.array(F.lit("p:")), "f:": F.array(F.concat(F.lit("f:"), F.col("path"))), "d:": named("d:"), "g:": begins}
    asked = F.concat(F.array().cast("array<string>"), *(asks[k] for k in sorted({r.kind for r in kinds})))
    rows = paths.select("rule_id", "path", F.explode(F.array_distinct(asked)).alias("_ask"))
    met = rows.join(e, (F.col("rule_id") == F.col("_r")) & (F.col("_ask") == F.col("_of"))).filter("_g IS NULL OR path rlike _g")
    first = met.groupBy("rule_id", "path").agg(F.min_by("exemption", "ordinal").alias("exemption"))
    return violations.join(first, ["rule_id", "path"], "left")


def compliance(violations: DataFrame, learn_at: int = 3, ask_below: float = 0.6) -> DataFrame:
    """Decisions over violations (rule_id, domain, path, ts, id, confidence, exemption).

    Inviolable ones block. An exemption accepts. The learn_at-th flexible hit of a
    rule in a path makes one; later hits there are accepted. Else a confidence under
    ask_below asks, and the rest warn. Hits are numbered per rule and path, so the
    order that matters is inside one small window.
    """
    w = W.partitionBy("rule_id", "path").orderBy("ts", "id")
    rows = violations.withColumn("tier", tier(F.col("rule_id"), F.col("domain"))).withColumn("occurrence", F.row_number().over(w))
    flexible = F.col("tier") == "flexible"
    action = F.when(F.col("tier") == "inviolable", "block").when(F.col("exemption").isNotNull(), "accept").when(flexible & (F.col("occurrence") == learn_at), "learn").when(flexible & (F.col("occurrence") > learn_at), "accept").when(F.col("confidence") < ask_below, "ask").otherwise("warn")
    return rows.withColumn("action", action)


def feedback(events: DataFrame, key: Sequence[str], permanent_at: int = 5) -> DataFrame:
    """(key, accepts, rejects, adjustment, permanent) of events (verdict, ts, id).

    The adjustment is 0.3 times the share of the last verdict's kind, with its sign.
    """
    yes = F.col("verdict") == "accept"
    rows = events.groupBy(*key).agg(F.count_if(yes).alias("accepts"), F.count_if(~yes).alias("rejects"), F.max_by("verdict", F.struct("ts", "id")).alias("last_verdict"))
    n = F.col("accepts") + F.col("rejects")
    adj = F.when(F.col("last_verdict") == "accept", F.col("accepts") / n * 0.3).otherwise(-F.col("rejects") / n * 0.3)
    return rows.withColumn("adjustment", adj).withColumn("permanent", F.greatest("accepts", "rejects") >= permanent_at)


def confidence(base: Column, boosts: Sequence[Column], penalties: Sequence[Column], adjustment: Column | None = None) -> Column:
    total = base
    for b in boosts:
        total = total + b
    for p in penalties:
        total = total - p
    if adjustment is not None:
        total = total + F.coalesce(adjustment, F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def level(value: Column, cuts: tuple[float, float, float] = (0.6, 0.8, 0.95)) -> Column:
    """ask, warn, pass or certain."""
    return F.when(value < cuts[0], "ask").when(value < cuts[1], "warn").when(value < cuts[2], "pass").otherwise("certain")


def memory_tiers(entries: DataFrame, as_of: Column) -> DataFrame:
    """entries with tier by age: five minutes short, one hour medium, long after that; read-through keeps the newest use."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.greatest("created_at", F.coalesce("last_used", "created_at")))
    return entries.withColumn("age_s", age).withColumn("tier", F.when(age <= 300, "short").when(age <= 3600, "medium").otherwise("long"))


def pruned(entries: DataFrame, as_of: Column, days: int = 30, recalls: int = 5) -> DataFrame:
    """Entries that are young, often recalled or marked helpful."""
    return entries.filter((F.datediff(as_of, "created_at") < days) | (F.col("recall_count") > recalls) | F.coalesce("helpful", F.lit(False)))


def upserted(state: DataFrame, changes: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key of both."""
    both = state.unionByName(changes)
    rest = [c for c in state.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("s")).select(*key, *(F.col("s")[c].alias(c) for c in rest))


def merged_thresholds(a: Column, b: Column) -> Column:
    """Two maps of thresholds as one; of a common key the smaller value."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(F.least(x, y), x, y))


def layered(*maps: Column) -> Column:
    """Settings of several levels; later ones win."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda k, x, y: F.coalesce(y, x))
    return out
