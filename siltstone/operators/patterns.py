"""Pattern algebra: literal, regular expression, and, or, not, as column expressions.

A pattern is compiled on the driver to literal expressions, so the regular
expressions are compiled once per task and nothing is joined. A containment test
of the whole text comes first; lines are only looked at where it holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = re.compile(r"[\\^$.|?*+()\[\]{}]")
#: Constructs without a meaning in linear-time dialects; packs that use them are refused.
_LOOKAROUND = re.compile(r"\(\?(=|!|<=|<!)|\\[1-9]")


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Pattern:
    kind: str
    value: str = ""
    parts: tuple[Pattern, ...] = ()

    def found(self, text: Column) -> Column:
        """Whether the pattern holds for a whole text."""
        if self.kind == "text":
            return F.contains(text, F.lit(self.value))
        if self.kind == "regex":
            return text.rlike(self.value)
        inner = [p.found(text) for p in self.parts]
        if self.kind == "not":
            return ~inner[0]
        out = inner[0]
        for x in inner[1:]:
            out = (out & x) if self.kind == "and" else (out | x)
        return out

    def count(self, text: Column) -> Column:
        """Hits that do not overlap: of `and` those of its first part, of `or` the sum, of `not` one."""
        if self.kind == "text":
            return F.when(F.contains(text, F.lit(self.value)), ((F.length(text) - F.length(F.replace(text, F.lit(self.value), F.lit("")))) / len(self.value)).cast("int")).otherwise(0)
        if self.kind == "regex":
            return F.regexp_count(text, F.lit(self.value))
        if self.kind == "not":
            return F.when(self.found(text), 1).otherwise(0)
        if self.kind == "and":
            return F.when(self.found(text), self.parts[0].count(text)).otherwise(0)
        return sum((p.count(text) for p in self.parts[1:]), self.parts[0].count(text))

    def hits(self, text: Column, lines: Column) -> Column:
        """array<struct<line, n>>: the lines with hits. A `not` has its hit in line 1."""
        if self.kind == "not":
            return F.when(self.found(text), F.array(F.struct(F.lit(1).alias("line"), F.lit(1).alias("n"))))
        first = self.parts[0] if self.kind == "and" else self
        each = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), first.count(x).alias("n")))
        return F.when(self.found(text), F.filter(each, lambda h: h["n"] > 0))


def parse(spec: str) -> Pattern:
    """A pattern from `text:`, `regex:`, `and:`, `or:`, `not:` and its rest; without a prefix it is
    a regular expression if it has a metacharacter and is valid, else text."""
    head, sep, rest = spec.partition(":")
    if sep and head in ("and", "or"):
        parts = tuple(parse(p.strip()) for p in rest.split(",") if p.strip())
        if not parts:
            raise PatternError(f"{spec!r} has no parts")
        return Pattern(head, parts=parts)
    if sep and head == "not":
        return Pattern("not", parts=(parse(rest.strip()),))
    if sep and head == "text":
        return _text(rest)
    if sep and head == "regex":
        return _regex(rest)
    if _META.search(spec):
        try:
            return _regex(spec)
        except re.error:
            return _text(spec)
    return _text(spec)


def _text(value: str) -> Pattern:
    if not value:
        raise PatternError("an empty text is found everywhere")
    return Pattern("text", value)


def _regex(value: str) -> Pattern:
    if _LOOKAROUND.search(value):
        raise PatternError(f"{value!r} looks around or back")
    re.compile(value)
    return Pattern("regex", value)
