"""Severities, scores and clamps as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from worst, and what a finding of each takes from a file's score.
SEVERITIES = ["critical", "error", "warning", "info", "hint"]
PENALTIES = {"critical": 0.1, "error": 0.1, "warning": 0.03, "info": 0.01, "hint": 0.005}


def _lookup(column: Column, values: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for key, value in values.items():
        out = out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    """0 for the worst; unknown ones come last."""
    return _lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}, len(SEVERITIES))


def penalty(severity: Column) -> Column:
    return _lookup(severity, PENALTIES, 0.0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def quality(errors: Column, warnings: Column, infos: Column) -> Column:
    """100 less 10 for an error, 2 for a warning, a half for an info, from 0 to 100."""
    return clamp(F.lit(100.0) - errors * 10 - warnings * 2 - infos * 0.5, 0.0, 100.0)


def file_score(total_penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - total_penalty)


def decay(days: Column, half_life: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def multi_signal(relevance: Column, age_days: Column, importance: Column) -> Column:
    """0.4 relevance, 0.3 recency (halved every 30 days), 0.3 importance, from 0 to 1."""
    return clamp(relevance * 0.4 + decay(age_days) * 0.3 + importance * 0.3, 0.0, 1.0)


def maintainability(volume: Column, cyclomatic: Column, lines: Column) -> Column:
    """171 - 5.2 ln V - 0.23 C - 16.2 ln L, scaled to 0..100."""
    raw = F.lit(171.0) - F.log(F.greatest(volume, F.lit(1.0))) * 5.2 - cyclomatic * 0.23 - F.log(F.greatest(lines, F.lit(1.0))) * 16.2
    return clamp(raw * 100 / 171, 0.0, 100.0)
