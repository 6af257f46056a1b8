"""Validation of sources by layers in an order: a layer is a function from sources to findings, and new ones are just added.

An error of the gate layer ends a source's run: what later layers find there does not count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layers, lines, memory, packs, rules


@dataclass(frozen=True)
class Layer:
    """find: from sources (key, language, text) and the key's columns to findings (key, rule_id, severity, line)."""

    name: str
    order: int
    find: Callable[[DataFrame, Sequence[str]], DataFrame]


def syntax(texts: DataFrame, key: Sequence[str]) -> DataFrame:
    bad = lines.balance(texts, key).filter("unbalanced OR early_close")
    return bad.select(*key, F.lit("SYNTAX001").alias("rule_id"), F.lit("error").alias("severity"), F.lit(1).alias("line"))


def items(texts: DataFrame, key: Sequence[str]) -> DataFrame:
    found = layers.items(lines.line_table(texts, key), key, packs.ITEMS)
    return found.select(*key, "rule_id", F.lit("info").alias("severity"), "line")


def logic(texts: DataFrame, key: Sequence[str]) -> DataFrame:
    rows = layers.flagged_lines(texts, [*key, "language"])
    return layers.line_findings(rows, [*key, "language"], packs.LOGIC, "language").select(*key, "rule_id", "severity", "line")


def security(texts: DataFrame, key: Sequence[str]) -> DataFrame:
    rows = layers.flagged_lines(texts.filter("language <> 'unknown'"), key, rules=packs.SECURITY)
    return layers.line_findings(rows, key, packs.SECURITY, comment=layers.CODE_COMMENT)


def fallback(texts: DataFrame, key: Sequence[str]) -> DataFrame:
    return layers.regex_findings(lines.line_table(texts.filter("language = 'unknown'"), key), key, packs.FALLBACK)


def supply_chain(texts: DataFrame, key: Sequence[str]) -> DataFrame:
    return layers.source_risks(lines.line_table(texts, key), key)


LAYERS = [Layer("syntax", 10, syntax), Layer("ast", 15, items), Layer("logic", 30, logic), Layer("security", 35, security), Layer("fallback_security", 35, fallback), Layer("supply_chain", 36, supply_chain)]


def run(texts: DataFrame, key: Sequence[str], chosen: Sequence[Layer] = LAYERS, gate: str = "syntax") -> DataFrame:
    """(key, layer, rule_id, severity, line, count) of all layers; texts: (key, language, text)."""
    found, order = None, []
    for layer in sorted(chosen, key=lambda x: x.order):
        rows = layer.find(texts, key).select(*key, F.lit(layer.name).alias("layer"), "rule_id", "severity", F.col("line").cast("int").alias("line"), F.lit(1).cast("long").alias("count"))
        found = rows if found is None else found.unionByName(rows)
        order.append(layer.name)
    return rules.halted(found, order, key, gate) if gate in order else found


def totals(texts: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: files, passed, failed, findings, errors, warnings of a run."""
    return memory.run_totals(rules.verdicts(texts, found, key), found)
