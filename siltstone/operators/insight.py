"""Decisions, prompts, projects and suggestions: lookups and scores over small histories joined to large ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import raw_terms
from ..session import saved as _saved

#: Bounds of words of ASCII letters, digits and underscores, whatever other letters stand beside them.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# Manifests that tell a project's language.
MANIFESTS = {"Cargo.toml": "rust", "package.json": "javascript", "requirements.txt": "python", "pyproject.toml": "python", "pom.xml": "java", "go.mod": "go"}
EFFECTS = {"boost_case": 0.1, "boost_pattern": 0.2, "whitelist": 0.3, "record": 0.0, "skip": 0.0}


def why(decisions: DataFrame, file: str, line: int) -> DataFrame:
    """Decisions at a place, newest first."""
    return decisions.filter((F.col("file") == file) & (F.col("line") == line)).orderBy(F.col("ts").desc(), "id")


def active(decisions: DataFrame) -> DataFrame:
    """Decisions that none supersedes."""
    gone = decisions.select(F.explode("supersedes").alias("id")).distinct()
    return decisions.join(gone, "id", "left_anti")


def superseded(decisions: DataFrame) -> DataFrame:
    return decisions.join(decisions.select(F.explode("supersedes").alias("id")).distinct(), "id", "left_semi")


def related(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other): links (a, b) of the given ids, in both directions."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    return both.join(ids.select("id").distinct(), "id", "left_semi").distinct()


def keyword_recall(query: Column, content: Column, tags: Column) -> Column:
    """1 if the content holds the query, else half for each tag that does."""
    low = F.lower(query)
    return F.when(F.contains(F.lower(F.coalesce(content, F.lit(""))), low), 1.0).otherwise(F.size(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), low))) * 0.5)


def hashed_embedding(text: Column, dim: int = 384) -> Column:
    """A text's terms, hashed into dim places with signs, of length 1: the stand-in where no model is at hand.

    Linear in the terms: they are hashed by SQL functions and summed by place in Arrow batches.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def summed(hashes: pd.Series) -> pd.Series:
        def one(h):
            h = np.asarray(h if h is not None else [], np.int64)
            v = np.bincount((h % dim).astype(np.int64), weights=np.where(h >> 40 & 1, 1.0, -1.0), minlength=dim)
            n = np.linalg.norm(v)
            return v / n if n else v

        return hashes.map(one)

    return summed(F.transform(raw_terms(text), lambda t: F.xxhash64(t)))


def prompt_facts(texts: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    """(key, words, questions, entities, files, vague, ambiguity): what a prompt names and leaves open."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    vague = F.regexp_count(F.lower(t), F.lit(f"{_B}(it|this|that|something|somehow|stuff|thing){_E}"))
    words = F.size(raw_terms(t))
    files = F.regexp_extract_all(t, F.lit(rf"[\w/]+\.[a-z]{{1,4}}{_E}"), 0)
    entities = F.array_distinct(F.regexp_extract_all(t, F.lit(f"{_B}[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+{_E}|{_B}[a-z]+(?:_[a-z0-9]+)+{_E}"), 0))
    open_ = F.when(words < 5, 0.4).otherwise(0.0) + F.least(F.lit(0.4), vague * 0.1) + F.when((F.size(files) == 0) & (F.size(entities) == 0), 0.2).otherwise(0.0)
    return texts.select(*key, words.alias("words"), F.regexp_count(t, F.lit(r"\?")).alias("questions"), F.size(entities).alias("entities"), F.size(files).alias("files"), vague.alias("vague"), F.round(open_, 6).alias("ambiguity"))


def scope_of(text: Column) -> Column:
    """project, file, function or unknown: the widest that a prompt names."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(f"{_B}(project|repo|repository|codebase|everywhere){_E}"), "project").when(low.rlike(rf"{_B}(file|module|\w+\.[a-z]{{1,4}}){_E}"), "file").when(low.rlike(f"{_B}(function|method|fn|def){_E}"), "function").otherwise("unknown")


def context_quality(text: Column, good: Sequence[Sequence[str]], bad: Sequence[Sequence[str]]) -> Column:
    """0.3 without a good pattern; else 0.5 and 0.1 for each of which all words are there (at most 0.95), less 0.1 for each bad one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = lambda ws: F.array(*(F.contains(low, F.lit(w)) for w in ws))
    count = lambda ps: sum((F.forall(every(p), lambda x: x).cast("int") for p in ps), F.lit(0))
    n = count(good)
    return F.greatest(F.lit(0.0), F.when(n == 0, 0.3).otherwise(F.least(F.lit(0.95), F.lit(0.5) + n * 0.1)) - count(bad) * 0.1)


def suggestions(findings: DataFrame, templates: DataFrame, level: str = "detailed", brief: int = 80) -> DataFrame:
    """findings with their template's suggestion; cut at a brief length unless detailed; a default where there is none."""
    text = F.coalesce("suggestion", F.concat(F.lit("review "), F.col("rule_id")))
    if level != "detailed":
        text = F.when(F.length(text) > brief, F.concat(F.left(text, F.lit(brief)), F.lit("..."))).otherwise(text)
    return findings.join(templates.select("rule_id", "suggestion"), "rule_id", "left").withColumn("suggestion", text)


def projects(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(root, language) of folders with a manifest."""
    name = F.element_at(F.split(path_col, "/"), -1)
    lang = F.coalesce(*(F.when(name == k, F.lit(v)) for k, v in MANIFESTS.items()))
    return files.select(F.regexp_replace(path_col, "/?[^/]*$", "").alias("root"), lang.alias("language")).filter("language IS NOT NULL").distinct()


def effects(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, boost, whitelisted, uncapped) of answers (answer) to questions; boost is the sum, at most 1."""
    w = F.coalesce(*(F.when(F.col("answer") == k, F.lit(v)) for k, v in EFFECTS.items()), F.lit(0.0))
    return events.groupBy(*key).agg(F.least(F.lit(1.0), F.sum(w)).alias("boost"), F.max((F.col("answer") == "whitelist").cast("int")).cast("boolean").alias("whitelisted"), F.sum(w).alias("uncapped"))


def analysed(violations: DataFrame, learned: DataFrame, key: Sequence[str]) -> DataFrame:
    """violations (confidence) with verdict: whitelisted and permanent patterns first, then the adjusted confidence."""
    rows = violations.join(learned.select(*key, "whitelisted", "permanent", "adjustment"), list(key), "left")
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") + F.coalesce("adjustment", F.lit(0.0))))
    return rows.withColumn("adjusted", c).withColumn("verdict", F.when(F.coalesce("whitelisted", F.lit(False)), "suppressed").when(F.coalesce("permanent", F.lit(False)), F.when(F.col("adjustment") > 0, "accepted").otherwise("rejected")).when(c < 0.25, "dropped").otherwise("reported"))


def candidates(learned: DataFrame, least: float = 0.7, severity: int = 3, k: int = 10) -> DataFrame:
    """The k commonest learned patterns that may become rules: confident and severe enough."""
    return learned.filter((F.col("confidence") >= least) & (F.col("severity") >= severity)).orderBy(F.col("n").desc(), "pattern").limit(k)


def by_tag(rules: DataFrame) -> DataFrame:
    """(tag, rules, worst): rules of each tag."""
    from ..functions.scores import severity_rank

    return rules.select("rule_id", "severity", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("rule_id").alias("rules"), F.min(severity_rank(F.col("severity"))).alias("worst"))


def commonest(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, value, n): each key's commonest value; ties go to the smaller."""
    n = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(*key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def chain_trust(certificates: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, trusted) of certificates (id, parent, valid): every link up to an anchor is valid.

    Pointers of valid certificates double until each is at an anchor or is gone. A chain
    has no more links than there are certificates: what is open beyond that is a circle.
    """
    roots = anchors.select(F.col("id").alias("at")).distinct()
    # invalid ones end every chain through them; a chain ends at its first anchor
    known = roots.withColumn("end", F.lit(True))
    up = certificates.filter("valid AND parent IS NOT NULL").select("id", F.col("parent").alias("at")).distinct()
    up = _saved(up.join(known, "at", "left").select("id", "at", F.coalesce("end", F.lit(False)).alias("end")))
    most, links = up.count(), 1
    while links <= most and not up.filter("NOT end").isEmpty():
        nxt = up.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("end").alias("_end"))
        moved = up.filter("NOT end").join(nxt, "at").select("id", F.col("_at").alias("at"), F.col("_end").alias("end"))
        up = _saved(up.filter("end").unionByName(moved).distinct())
        links *= 2
    own = certificates.filter("valid").join(roots.withColumnRenamed("at", "id"), "id", "left_semi").select("id")
    best = up.filter("end").select("id").unionByName(own).distinct().withColumn("trusted", F.lit(True))
    return certificates.select("id").join(best, "id", "left").select("id", F.coalesce("trusted", F.lit(False)).alias("trusted"))
