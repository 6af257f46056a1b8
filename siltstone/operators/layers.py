"""Layers of line rules over source files: logic, security, private rules, style, semantics, architecture.

All take a table of lines (key, line, content) as lines.line_table() makes, or
texts, and give findings (key, rule_id, line). Context is windows over the lines of
a file; what needs a stack runs per file in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .code import blanked

COMMENT = r"^\s*(//|#|\*|--)"
CODE_COMMENT = r"^\s*(//|/\*|#)"
GUARDS = r"is_some\(\)|is_ok\(\)|is_none\(\)|is_err\(\)|if let|match |unwrap_or|assert"
SAFETY = r"(?i)safety"
# Forms of well-known access tokens.
SECRETS = [r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"sk-[A-Za-z0-9]{20,}", r"xox[baprs]-[A-Za-z0-9-]+", r"AIza[0-9A-Za-z_-]{35}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(token|secret|password) = \"[^\"]+\""]
SQL_WORDS = ["SELECT ", "INSERT ", "UPDATE ", "DELETE ", "DROP ", " WHERE ", " FROM ", "UNION "]
SQL_BUILT = r"format!\(|\.format\(|f\"|f'|\" ?\+|' ?\+|%s"
# Domains by the letters an id begins with.
DOMAINS = {"SEC": "security", "LOGIC": "logic", "ARCH": "architecture", "STYLE": "style", "SUPP": "supply_chain", "COMPLEX": "complexity", "NB": "notebook", "SCOPE": "scope", "TYPE": "types"}


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    needle: str
    severity: str = "warning"
    language: str | None = None
    context: str | None = None  # in_loop, unguarded, unexplained, no_enum
    whole_word: bool = False
    in_comments: bool = False


_LOOP = re.compile("for|while|loop")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def loop_lines(text: pd.Series) -> pd.Series:
    """For each line of a source, whether it is inside a loop: by braces, or by indentation where there are none."""
    return text.map(lambda t: _loop_lines(t or ""))


def _loop_lines(text: str) -> list[bool]:
    if not _LOOP.search(text):
        return [False] * (text.count("\n") + 1)
    code = blanked(text).split("\n")
    head = re.compile(r"^\s*(for|while|loop)\b|\b(for|while)\s*\(")
    out: list[bool] = []
    if any("{" in x for x in code):
        depth, loops, waiting = 0, [], False
        for x in code:
            out.append(bool(loops))
            waiting = waiting or bool(head.search(x))
            for c in x:
                if c == "{":
                    depth += 1
                    if waiting:
                        loops.append(depth)
                        waiting = False
                elif c == "}":
                    if loops and loops[-1] == depth:
                        loops.pop()
                    depth = max(0, depth - 1)
        return out
    starts: list[int] = []
    for x in code:
        indent = len(x) - len(x.lstrip())
        if x.strip():
            while starts and indent <= starts[-1]:
                starts.pop()
        out.append(bool(starts))
        if re.match(r"\s*(for|while)\b", x):
            starts.append(indent)
    return out


_TEST = re.compile(r"^\s*#\[(cfg\(test\)|test|tokio::test|async_test|rstest)\]|\bfn (test|\w+_test\b)")
_TESTED = re.compile(_TEST.pattern, re.M)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def test_lines(text: pd.Series) -> pd.Series:
    """For each line of a source, whether it is part of a test module or a test function."""
    return text.map(lambda t: _test_lines(t or ""))


def _test_lines(text: str) -> list[bool]:
    if not _TESTED.search(text):
        return [False] * (text.count("\n") + 1)
    out, inside, opened, depth = [], False, False, 0
    for line, code in zip(text.split("\n"), blanked(text, hashes=False).split("\n"), strict=True):
        if not inside and _TEST.search(line):
            inside, opened, depth = True, False, 0
        out.append(inside)
        if inside:
            opened = opened or "{" in code
            depth += code.count("{") - code.count("}")
            inside = not opened or depth > 0
    return out


def flagged_lines(texts: DataFrame, key: Sequence[str], text_col: str = "text", rules: Sequence[LineRule] | None = None) -> DataFrame:
    """(key, line, content, in_loop, in_test) of sources; loops are only sought if one of the rules asks for them."""
    loops = loop_lines(F.col(text_col)) if rules is None or any(r.context == "in_loop" for r in rules) else F.array().cast("array<boolean>")
    # carriage returns go before the lines are rows: a filter on the content would take their removal with it, once for each rule
    each = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    each = F.when(F.contains(F.col(text_col), F.lit("\r")), F.transform(each, lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(each)
    rows = texts.select(*key, each.alias("_l"), loops.alias("_f"), test_lines(F.col(text_col)).alias("_t"))
    flag = lambda c: F.coalesce(f"_z.{c}", F.lit(False))
    return rows.select(*key, F.posexplode(F.arrays_zip("_l", "_f", "_t")).alias("_i", "_z")).select(*key, (F.col("_i") + 1).alias("line"), F.col("_z._l").alias("content"), flag("_f").alias("in_loop"), flag("_t").alias("in_test"))


def _hit(rule: LineRule, content: Column) -> Column:
    if rule.whole_word:
        return F.contains(content, F.lit(rule.needle)) & content.rlike(r"(^|[^A-Za-z0-9_.])" + re.escape(rule.needle) + (r"($|[^A-Za-z0-9_])" if rule.needle[-1].isalnum() else ""))
    return F.contains(content, F.lit(rule.needle))


def _outside_strings(content: Column, needle: str) -> Column:
    """Whether an even number of quotes stands before the first hit."""
    return (F.size(F.split(F.substring_index(content, needle, 1), '"', -1)) - 1) % 2 == 0


def line_findings(rows: DataFrame, key: Sequence[str], rules: Sequence[LineRule], language_col: str | None = None, comment: str = COMMENT) -> DataFrame:
    """(key, rule_id, severity, line) of rules whose needle and context hold; strings, tests and most comments do not count.

    Context flags are one window each over the file's lines and are made only if a
    rule asks for them; all rules are literal expressions of one projection.
    """
    w = W.partitionBy(*key).orderBy("line")
    asked = {r.context for r in rules}
    if "unguarded" in asked:
        rows = rows.withColumn("_guarded", F.max(F.col("content").rlike(GUARDS).cast("int")).over(w.rowsBetween(-10, 0)) == 1)
    if "unexplained" in asked:
        rows = rows.withColumn("_explained", F.max((F.col("content").rlike(COMMENT) & F.col("content").rlike(SAFETY)).cast("int")).over(w.rowsBetween(-3, 3)) == 1)
    c = F.col("content")
    # a comparison with a member of an enumeration compares no secret
    contexts = {"unguarded": lambda: ~F.col("_guarded"), "unexplained": lambda: ~F.col("_explained"), "in_loop": lambda: F.col("in_loop"), "no_enum": lambda: ~c.rlike("==.*::")}

    def one(r: LineRule) -> Column:
        ok = _hit(r, c) & _outside_strings(c, r.needle)
        if not r.in_comments:
            ok = ok & ~c.rlike(comment)
        if "in_test" in rows.columns:
            ok = ok & ~F.col("in_test")
        if r.language and language_col:
            ok = ok & (F.col(language_col) == r.language)
        ok = ok & contexts[r.context]() if r.context else ok
        return F.when(ok, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity")))

    # few lines hold any needle: the rules are for them alone, and lines that none can hit are not carried on
    some = [F.contains(c, F.lit(x)) for x in dict.fromkeys(r.needle for r in rules)]
    rows = rows.filter(reduce(Column.__or__, some))
    found = rows.select(*key, "line", F.explode(F.array_distinct(F.filter(F.array(*map(one, rules)), lambda x: x.isNotNull()))).alias("f"))
    return found.select(*key, "f.rule_id", "f.severity", "line")


def regex_findings(rows: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(key, rule_id, severity, line) of rules (id, expression, severity) that are found in a line; narrow."""
    each = [F.when(F.col("content").rlike("(?s)" + rx), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, rx, s in rules]
    found = rows.select(*key, "line", F.explode(F.array_distinct(F.filter(F.array(*each), lambda x: x.isNotNull()))).alias("f"))
    return found.select(*key, "f.rule_id", "f.severity", "line")


def source_risks(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, rule_id, severity, line): code that comes from elsewhere: built requires, imports from URLs, downloads into a shell."""
    c = F.col("content")
    has = lambda s: F.contains(c, F.lit(s))
    risks = [("SUPP004", "warning", has("require(") & has("+")), ("SUPP005", "warning", has("import") & c.rlike("https?://")), ("SUPP006", "error", c.rlike("curl|wget") & has("|") & has("bash"))]
    each = F.array(*(F.when(ok, F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, ok in risks))
    found = rows.filter(~c.rlike(r"^\s*(//|#|/\*|\*|--)")).select(*key, "line", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f"))
    return found.select(*key, "f.rule_id", "f.severity", "line")


def items(rows: DataFrame, key: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """(key, rule_id, line, n): kinds of items that a file has, the first of each and their number."""
    kind = F.regexp_extract("content", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(" + "|".join(kinds) + r")\b", 1)
    rule = F.coalesce(*(F.when(kind == k, F.lit(i)) for k, i in kinds.items()))
    return rows.select(*key, "line", rule.alias("rule_id")).filter("rule_id IS NOT NULL").groupBy(*key, "rule_id").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))


def secrets(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines with the form of an access token, by one alternation."""
    return rows.filter(F.col("content").rlike("|".join(SECRETS))).select(*key, F.lit("SEC090").alias("rule_id"), "line")


def sql_built(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines that build a text and hold a word of SQL: one finding a line."""
    words = "|".join(SQL_WORDS)
    return rows.filter(F.upper("content").rlike(words) & F.col("content").rlike(SQL_BUILT)).select(*key, F.lit("SEC091").alias("rule_id"), "line")


def private_rules(texts: DataFrame, key: Sequence[str], forbidden: dict[str, str], required: dict[str, str], max_lines: int, text_col: str = "text") -> DataFrame:
    """(key, rule_id): forbidden texts that are there, required ones that are not, and files that are too long."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    each = [F.when(F.contains(t, F.lit(s)), F.lit(i)) for i, s in forbidden.items()] + [F.when(~F.contains(t, F.lit(s)), F.lit(i)) for i, s in required.items()]
    each.append(F.when(F.size(F.split(t, "\n", -1)) > max_lines, F.lit("PRIV_LINES")))
    return texts.select(*key, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("rule_id"))


def unreachable(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines with code after a return, break, continue or raise of the same indentation."""
    w = W.partitionBy(*key).orderBy("line")
    body = rows.filter(F.trim("content") != "")
    indent = lambda c: F.length(F.regexp_extract(c, r"^(\s*)", 1))
    body = body.withColumn("_p", F.lag("content").over(w))
    ends = F.col("_p").rlike(r"^\s*(return|break|continue|raise)\b[^{(\[]*;?\s*$")
    return body.filter(ends & (indent(F.col("content")) == indent(F.col("_p"))) & ~F.col("content").rlike(r"^\s*([})\]]|else|elif|except|finally|case|default|#|//)")).select(*key, F.lit("SEM001").alias("rule_id"), "line")


def bindings(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, name, line, nth) of `let`, `var`, `const` bindings; nth over 1 shadows an earlier one."""
    found = rows.withColumn("name", F.regexp_extract("content", r"^\s*(?:let|var|const)\s+(?:mut\s+)?([A-Za-z_]\w*)", 1)).filter("name <> ''")
    return found.select(*key, "name", "line", F.row_number().over(W.partitionBy(*key, "name").orderBy("line")).alias("nth"))


def unused_bindings(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bindings whose name stands once in their file: names are joined to counts of words."""
    words = rows.select(*key, F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z_]\w*"), 0)).alias("name")).groupBy(*key, "name").agg(F.count(F.lit(1)).alias("n"))
    return bindings(rows, key).filter("name NOT LIKE '\\\\_%'").join(words.filter("n = 1"), [*key, "name"], "left_semi").select(*key, F.lit("SEM002").alias("rule_id"), "line", "name")


def functions(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, name, line, length, documented): length to the next function or the end; a comment before it documents it."""
    w = W.partitionBy(*key).orderBy("line")
    every = rows.withColumn("_before", F.lag("content").over(w)).withColumn("_last", F.max("line").over(W.partitionBy(*key)))
    defs = every.withColumn("name", F.regexp_extract("content", r"^\s*(?:pub\s+|async\s+|export\s+|static\s+)*(?:fn|def|function|func)\s+([A-Za-z_]\w*)", 1)).filter("name <> ''")
    return defs.select(*key, "name", "line", (F.coalesce(F.lead("line").over(w), F.col("_last") + 1) - F.col("line")).alias("length"), F.coalesce(F.col("_before").rlike(r"^\s*(///|//|#|\*/|\"\"\")"), F.lit(False)).alias("documented"))


def magic_numbers(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, line, n): numbers of two digits and more outside comments and definitions of constants."""
    n = F.regexp_count("content", F.lit(r"(^|[^\w.])[0-9]{2,}(\.[0-9]+)?($|[^\w.])"))
    return rows.filter(~F.col("content").rlike(COMMENT) & ~F.col("content").rlike(r"^\s*(const|static|final|[A-Z_]+ =)")).select(*key, "line", n.alias("n")).filter("n > 0")


def complexity(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, cyclomatic, cognitive, max_nesting): branches, branches weighted by nesting, deepest braces or indentation."""
    w = W.partitionBy(*key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    step = F.regexp_count("content", F.lit(r"\{")) - F.regexp_count("content", F.lit(r"\}"))
    branch = F.regexp_count("content", F.lit(r"\b(if|for|while|case|catch|except|elif|match)\b"))
    run = rows.withColumn("_s", F.sum(step).over(w)).withColumn("_d", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).withColumn("_b", branch)
    before = F.greatest(F.lit(0), F.col("_d") - F.greatest(F.lit(0), step))
    return run.withColumn("_n", before).groupBy(*key).agg((F.sum("_b") + 1).alias("cyclomatic"), F.sum(F.col("_b") * (1 + F.col("_n"))).alias("cognitive"), F.max("_d").alias("max_nesting"))


#: What defines something that calls, by language: the name is the group.
DEFINITIONS = {
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+([A-Za-z_]\w*)",
    "python": r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?\s+([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function|\([^)]*\)\s*=>))",
    "go": r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "c": r"^(?:[A-Za-z_][\w:<>*&,]*\s+)+\**([A-Za-z_]\w*)\s*\([^;]*$",
    "html": r"^<(nav|article|header|footer|section|aside|main|body)\b",
}
#: What refers to something, where it is not a name before a bracket.
REFERENCES = {"html": r'^<a [^>]*href="/?([^"]+)"'}
#: Words before brackets that call nothing.
KEYWORDS = ["if", "for", "while", "switch", "match", "return", "catch", "fn", "def", "func", "function", "sizeof", "and", "or", "not", "in", "elif", "loop", "await", "yield", "class", "new", "assert", "print", "with", "lambda", "case", "else", "do"]


def definitions(rows: DataFrame, key: Sequence[str], language: str) -> DataFrame:
    """(key, name, line) of what lines (key, line, content) define."""
    return _defined(rows, language).filter("_def IS NOT NULL").select(*key, F.col("_def").alias("name"), "line")


def _defined(rows: DataFrame, language: str) -> DataFrame:
    rx = DEFINITIONS[language]
    groups = re.compile(rx).groups
    names = [F.nullif(F.regexp_extract("content", rx, n + 1), F.lit("")) for n in range(groups)]
    return rows.withColumn("_def", F.coalesce(*names) if groups > 1 else names[0])


def calls(rows: DataFrame, key: Sequence[str], language: str) -> DataFrame:
    """(key, line, caller, ref): what lines refer to, and the definition that encloses them: the last one above.

    Strings and comment lines do not count. The enclosing definition is carried over the lines of a file by one window; calls before any
    definition have none.
    """
    rows = _defined(rows, language)
    if language in REFERENCES:
        found = F.regexp_extract_all("content", F.lit(REFERENCES[language]), 1)
    else:
        plain = F.regexp_replace("content", r"\"(?:[^\"\\]|\\.)*\"", '\"\"')
        names = F.regexp_extract_all(plain, F.lit(r"([A-Za-z_][\w$]*(?:(?:::|\.)[A-Za-z_][\w$]*)*)!?\s*\("), 1)
        # a name that the line defines stands before a bracket as well
        found = F.filter(names, lambda x: ~x.isin(*KEYWORDS) & ~x.eqNullSafe(F.col("_def")))
        found = F.when(F.col("content").rlike(COMMENT), F.array().cast("array<string>")).otherwise(found)
    above = W.partitionBy(*key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("caller", F.last("_def", ignorenulls=True).over(above))
    return rows.select(*key, "line", "caller", F.explode(found).alias("ref"))


def imports(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, line, module, wildcard) of import lines."""
    m = F.coalesce(*(F.when(F.col("content").rlike(rx), F.regexp_extract("content", rx, 1)) for rx in (r"^\s*from\s+([\w.]+)\s+import", r"^\s*import\s+([\w.]+)", r"^\s*use\s+([\w:]+)", r"^\s*import\s.*from\s+['\"]([^'\"]+)", r"^\s*#include\s+[<\"]([^>\"]+)")))
    return rows.withColumn("module", m).filter("module IS NOT NULL").select(*key, "line", "module", F.col("content").rlike(r"\*\s*;?\s*$").alias("wildcard"))


def layer_of(path: Column, folders: dict[str, Sequence[str]]) -> Column:
    """The layer whose folder a path goes through; null without one."""
    low = F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    return F.coalesce(*(F.when(low.rlike("/(" + "|".join(names) + ")/"), F.lit(layer)) for layer, names in folders.items()))


def architecture(import_rows: DataFrame, key: Sequence[str], layer: Column, may_use: dict[str, Sequence[str]], forbidden: Sequence[tuple[str, str]], most: int = 20) -> DataFrame:
    """(key, rule_id, detail) of imports (line, module, wildcard) of files in layers.

    ARCH002 a module imported again, ARCH003 a forbidden import, ARCH004 another layer
    than may be used, ARCH005 too many imports, ARCH006 a wildcard. The layer of a module is the first whose name it holds.
    """
    target = F.coalesce(*(F.when(F.contains("module", F.lit(x)), F.lit(x)) for x in may_use))
    allowed = F.coalesce(*(F.when(F.col("_layer") == a, F.col("_target").isin(*b, a)) for a, b in may_use.items()))
    rows = import_rows.withColumn("_layer", layer).withColumn("_target", target)
    banned = F.lit(False)
    for a, text in forbidden:
        banned = banned | (F.contains("module", F.lit(text)) & (F.lit(a == "*") | (F.col("_layer") == a)))
    each = F.array(F.when(banned, F.lit("ARCH003")), F.when(~allowed, F.lit("ARCH004")), F.when(F.col("wildcard"), F.lit("ARCH006")))
    found = rows.select(*key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("rule_id"), F.col("module").alias("detail"))
    again = import_rows.groupBy(*key, "module").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key, F.lit("ARCH002").alias("rule_id"), F.col("module").alias("detail"))
    many = import_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*key, F.lit("ARCH005").alias("rule_id"), F.col("n").cast("string").alias("detail"))
    return found.unionByName(again).unionByName(many)


def architecture_graph(edges: DataFrame, layers: DataFrame, may_use: dict[str, Sequence[str]]) -> DataFrame:
    """(rule_id, detail) of module edges (src, dst): ARCH001 cycles of dependencies, ARCH007 edges that cross layers where they may not."""
    from . import graph

    text = lambda c: F.col(c).cast("string")
    round_ = graph.cycles(edges).select(F.lit("ARCH001").alias("rule_id"), F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ").alias("detail"))
    crossed = graph.layer_violations(edges, layers, [(a, b) for a, bs in may_use.items() for b in bs])
    return round_.unionByName(crossed.select(F.lit("ARCH007").alias("rule_id"), F.concat_ws(" -> ", text("src"), text("dst")).alias("detail")))


def domain(rule_id: Column) -> Column:
    """A rule's domain by the letters its id begins with."""
    letters = F.regexp_extract(rule_id, "^[A-Za-z]+", 0)
    out = F.when(F.lit(False), "general")
    for k, v in DOMAINS.items():
        out = out.when(F.upper(letters) == k, v)
    return out.otherwise("general")
