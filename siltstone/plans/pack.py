"""A rule pack for prose and pages, and the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Sequence

from ..functions.scores import PENALTIES, SEVERITIES
from ..operators.layers import COMMENT, GUARDS, SAFETY
from ..operators.patterns import Pattern, parse
from ..operators.rules import Rule

PROSE = [
    Rule("PROSE001", "regex:[Ll]icen[sc]e", "info", "names a licence", "legal", "licence"),
    Rule("PROSE002", "regex:[A-Za-z0-9._]+@[A-Za-z0-9]+\\.[a-z]+", "warning", "holds an address", "privacy", "personal"),
    Rule("PROSE003", "regex:[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}", "error", "holds a network address", "privacy", "personal"),
    Rule("PROSE004", "text:token = ", "critical", "holds a secret", "security", "secret"),
    Rule("PROSE005", "text:!!", "hint", "shouts", "style", "style"),
    Rule("PROSE006", "and:License, version", "info", "names a licence version", "legal", "licence"),
    Rule("PROSE007", "or:text:$$$,text:###", "warning", "holds noise", "style", "style"),
    Rule("PROSE008", "not:text:.", "warning", "has no full stop", "style", "style"),
]
LAYERS = ["syntax", "security", "privacy", "legal", "style"]
PAGES = [
    Rule("PAGE001", "not:regex:</html>", "error", "is cut off", "syntax", "page"),
    Rule("PAGE002", "regex:<script", "warning", "has scripts", "security", "page"),
    Rule("PAGE003", "text:href=\"http://", "error", "has a plain link", "privacy", "page"),
    Rule("PAGE004", "regex:<img[^>]*>", "info", "has images", "style", "page"),
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def count_sql(p: Pattern, col: str) -> str:
    """Hits of a text or expression in col."""
    if p.kind == "text":
        return f"((length({col}) - length(replace({col}, {_quoted(p.value)}, ''))) // {len(p.value)})"
    if p.kind == "regex":
        return f"len(regexp_extract_all({col}, {_quoted(p.value)}))"
    return " + ".join(count_sql(x, col) for x in p.parts)


def found_sql(p: Pattern, col: str) -> str:
    if p.kind == "text":
        return f"contains({col}, {_quoted(p.value)})"
    if p.kind == "regex":
        return f"regexp_matches({col}, {_quoted(p.value)})"
    if p.kind == "not":
        return f"NOT {found_sql(p.parts[0], col)}"
    return "(" + f" {p.kind.upper()} ".join(found_sql(x, col) for x in p.parts) + ")"


def findings_sql(rules: Sequence[Rule], table: str, key: str, col: str) -> str:
    """WITH clauses t, l (lines) and f (findings) of a pack over a table."""
    each = []
    for r in rules:
        p = parse(r.pattern)
        facts = f"'{r.rule_id}' AS rule_id, '{r.layer}' AS layer, '{r.severity}' AS severity, {_quoted(r.message)} AS message"
        if p.kind == "not":
            each.append(f"SELECT {key}, {facts}, 1::BIGINT AS n, 1 AS line FROM t WHERE {found_sql(p, 'txt')}")
        else:
            first = p.parts[0] if p.kind == "and" else p
            each.append(f"SELECT {key}, {facts}, CAST(sum({count_sql(first, 'content')}) AS BIGINT) AS n, CAST(min(line) AS INT) AS line FROM l WHERE {count_sql(first, 'content')} > 0 AND {key} IN (SELECT {key} FROM t WHERE {found_sql(p, 'txt')}) GROUP BY {key}")
    return f"""WITH t AS (SELECT {key}, coalesce({col}, '') AS txt FROM {table}),
l0 AS (SELECT {key}, string_split(replace(txt, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM t),
l AS (SELECT {key}, unnest(ls) AS content, unnest(range(1, len(ls) + 1)) AS line FROM l0),
f AS ({' UNION ALL '.join(each)})"""


def totals_sql(key: str) -> str:
    """A column for each severity, and the penalty, from f."""
    sums = ", ".join(f"CAST(coalesce(sum(n) FILTER (severity = '{s}'), 0) AS BIGINT) AS n_{s}" for s in SEVERITIES)
    cases = " ".join(f"WHEN '{s}' THEN {p}::DOUBLE" for s, p in PENALTIES.items())
    return f"SELECT {key}, {sums}, sum(n * CASE severity {cases} END) AS penalty FROM f GROUP BY {key}"


def line_rule_sql(rule, comment: str) -> str:
    """Whether a line, content, has a line rule's hit: as layers.line_findings, but for rules that ask for loops."""
    needle, quote = _quoted(rule.needle), _quoted('"')
    before = f"left(content, strpos(content, {needle}) - 1)"
    ok = [f"contains(content, {needle})", f"(length({before}) - length(replace({before}, {quote}, ''))) % 2 = 0"]
    if rule.whole_word:
        ok.append(f"regexp_matches(content, {_quoted('(^|[^A-Za-z0-9_.])' + re.escape(rule.needle) + ('($|[^A-Za-z0-9_])' if rule.needle[-1].isalnum() else ''))})")
    if not rule.in_comments:
        ok.append(f"NOT regexp_matches(content, {_quoted(comment)})")
    context = {"unguarded": "NOT guarded", "unexplained": "NOT explained", "no_enum": "NOT regexp_matches(content, '==.*::')"}
    return " AND ".join(ok + ([context[rule.context]] if rule.context else []))


def line_pack_sql(table: str, key: str, col: str, packs: dict[str, tuple[Sequence, str]], expressions: dict[str, Sequence]) -> str:
    """(layer, rule_id, key, line) of packs of line rules (with their comments) and of expressions over the lines of a table."""
    each = [f"SELECT {key}, line, '{layer}' AS layer, '{r.rule_id}' AS rule_id FROM x WHERE {line_rule_sql(r, comment)}" for layer, (rules, comment) in packs.items() for r in rules]
    each += [f"SELECT {key}, line, '{layer}', '{i}' FROM x WHERE regexp_matches(content, {_quoted(rx)})" for layer, rules in expressions.items() for i, rx, _ in rules]
    return f"""WITH t AS (SELECT {key}, coalesce({col}, '') AS txt FROM {table}),
l0 AS (SELECT {key}, string_split(replace(txt, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM t),
l AS (SELECT {key}, unnest(ls) AS content, unnest(range(1, len(ls) + 1)) AS line FROM l0),
x AS (SELECT *, max(regexp_matches(content, {_quoted(GUARDS)})::INT) OVER (PARTITION BY {key} ORDER BY line ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) = 1 AS guarded,
        max((regexp_matches(content, {_quoted(COMMENT)}) AND regexp_matches(content, {_quoted(SAFETY)}))::INT) OVER (PARTITION BY {key} ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS explained FROM l)
SELECT DISTINCT {key}, CAST(line AS INT) AS line, layer, rule_id FROM ({" UNION ALL ".join(each)})"""
