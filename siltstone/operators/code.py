"""Analyses of source code: stripping, features, Python syntax trees, scopes, calls, notebooks.

What is sequential or needs a parser runs in Arrow batches, row by row without state
between rows; everything after the rows exist is DataFrame expressions.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that make a branch in most languages, and calls that may fail hard.
BRANCHES = ["if", "for", "while", "case", "catch", "except", "elif", "match"]
UNCHECKED = r"\.unwrap\(\)|\.expect\("


_BEGINS = re.compile("[/#\"']")


def blanked(code: str, hashes: bool = True, slashes: bool = True) -> str:
    """code with the insides of strings and comments as blanks; lines and columns stay."""
    out, i, n = [], 0, len(code)
    while i < n:
        two = code[i : i + 2]
        if (slashes and two == "//") or (hashes and code[i] == "#"):
            j = code.find("\n", i)
            j = n if j < 0 else j
            out.append(" " * (j - i))
            i = j
        elif slashes and two == "/*":
            j = code.find("*/", i + 2)
            j = n if j < 0 else j + 2
            out.append(re.sub(r"[^\n]", " ", code[i:j]))
            i = j
        elif code[i] in "\"'" and (code[i] == '"' or hashes):
            quote = code[i] * 3 if code.startswith(code[i] * 3, i) else code[i]
            j = i + len(quote)
            while j < n and not code.startswith(quote, j):
                if code[j] == "\\":
                    j += 1
                elif code[j] == "\n" and len(quote) == 1:
                    break
                j += 1
            j = min(n, j)
            out.append(code[i : i + len(quote)] + re.sub(r"[^\n]", " ", code[i + len(quote) : j]))
            i = j
            if code.startswith(quote, j):
                out.append(quote)
                i += len(quote)
        else:
            m = _BEGINS.search(code, i + 1)
            j = m.start() if m else n
            out.append(code[i:j])
            i = j
    return "".join(out)


@F.pandas_udf(T.StringType())
def stripped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: blanked(t or ""))


def features(texts: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    """(key, line_count, functions, cyclomatic, unwraps, params, documented): counts of expressions; narrow."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda rx: F.regexp_count(t, F.lit(rx))
    branch = count(r"\b(" + "|".join(BRANCHES) + r")\b") + count(r"&&|\|\||\?")
    return texts.select(*key, F.size(F.split(t, "\n", -1)).alias("line_count"), count(r"\b(fn|def|function|func)\s+\w+").alias("functions"), (branch + 1).alias("cyclomatic"), count(UNCHECKED).alias("unwraps"), count(r"TODO|FIXME|HACK").alias("smells"), t.rlike(r'///|/\*\*|"""').alias("documented"))


_NODE = T.StructType([T.StructField(n, k) for n, k in (("node_id", T.IntegerType()), ("parent_id", T.IntegerType()), ("depth", T.IntegerType()), ("kind", T.StringType()), ("name", T.StringType()), ("line", T.IntegerType()))])


def _with_rows(texts: DataFrame, key: Sequence[str], text_col: str, out: T.StructType, rows_of) -> DataFrame:
    """(key, out fields): the rows that rows_of(text) gives."""
    schema = T.StructType([*(texts.schema[k] for k in key), *out.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*k, *r) for *k, t in b.itertuples(index=False) for r in rows_of(t or "")]
            yield pd.DataFrame(rows, columns=schema.names)

    return texts.select(*key, text_col).mapInPandas(run, schema)


def _tree(text: str):
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    stack, number = [(root, -1, 0)], 0
    while stack:
        node, parent, depth = stack.pop()
        me, number = number, number + 1
        name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None) or getattr(node, "arg", None)
        yield me, parent, depth, type(node).__name__, name, getattr(node, "lineno", 0)
        stack += [(c, me, depth + 1) for c in reversed(list(ast.iter_child_nodes(node)))]


def python_nodes(texts: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    """The flattened syntax tree of Python sources: (key, node_id, parent_id, depth, kind, name, line)."""
    return _with_rows(texts, key, text_col, _NODE, _tree)


def tree_stats(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    return nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("max_depth"), F.countDistinct("kind").alias("kinds"))


def matching(nodes: DataFrame, key: Sequence[str], kind: str, having: Sequence[str] = (), without: Sequence[str] = ()) -> DataFrame:
    """Nodes of a kind with a direct child of each kind in having and none of those in without."""
    out = nodes.filter(F.col("kind") == kind)
    child = lambda k: nodes.filter(F.col("kind") == k).select(*key, F.col("parent_id").alias("node_id")).distinct()
    for k in having:
        out = out.join(child(k), [*key, "node_id"], "left_semi")
    for k in without:
        out = out.join(child(k), [*key, "node_id"], "left_anti")
    return out


_SCOPE = T.StructType([T.StructField(n, k) for n, k in (("issue", T.StringType()), ("name", T.StringType()), ("line", T.IntegerType()))])


def _scope_issues(text: str):
    """SCOPE001 unused, SCOPE002 undefined, SCOPE003 shadowing, over nested functions of one module."""
    import builtins

    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    known = set(dir(builtins))

    def walk(node, outer):
        own, used, inner = {}, [], []

        def see(n):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own.setdefault(n.name, n.lineno)
                inner.append(n)
                for d in n.decorator_list:
                    see(d)
                return
            if isinstance(n, ast.Lambda):
                inner.append(n)
                return
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                for a in n.names:
                    own.setdefault((a.asname or a.name).split(".")[0], n.lineno)
            if isinstance(n, ast.ExceptHandler) and n.name:
                own.setdefault(n.name, n.lineno)
            if isinstance(n, ast.Name):
                if isinstance(n.ctx, ast.Load):
                    used.append((n.id, n.lineno))
                else:
                    own.setdefault(n.id, n.lineno)
            if isinstance(n, ast.arg):
                own.setdefault(n.arg, n.lineno)
            for c in ast.iter_child_nodes(n):
                see(c)

        for c in ast.iter_child_nodes(node):
            see(c)
        names = {n for n, _ in used}
        below = set()
        issues = []
        for f in inner:
            got, seen = walk(f, outer | set(own))
            issues += got
            below |= seen
        for n, line in used:
            if n not in own and n not in outer and n not in known:
                issues.append(("SCOPE002", n, line))
        if not isinstance(node, ast.Module):
            for n, line in own.items():
                if not isinstance(node, ast.ClassDef) and n not in names and n not in below and not n.startswith("_") and n != "self":
                    issues.append(("SCOPE001", n, line))
                if n in outer and not isinstance(node, ast.ClassDef):
                    issues.append(("SCOPE003", n, line))
        return issues, (names | below) - set(own)

    yield from sorted(walk(root, set())[0], key=lambda x: (x[2], x[0], x[1]))


def scope_issues(texts: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    return _with_rows(texts, key, text_col, _SCOPE, _scope_issues)


_TYPE = T.StructType([T.StructField(n, k) for n, k in (("issue", T.StringType()), ("detail", T.StringType()), ("line", T.IntegerType()))])


def _literal_type(node, env) -> str | None:
    if isinstance(node, ast.Constant):
        return type(node.value).__name__
    for kind, name in ((ast.List, "list"), (ast.Dict, "dict"), (ast.Set, "set"), (ast.Tuple, "tuple"), (ast.JoinedStr, "str")):
        if isinstance(node, kind):
            return name
    if isinstance(node, ast.Name):
        return env.get(node.id)
    if isinstance(node, ast.BinOp):
        a, b = _literal_type(node.left, env), _literal_type(node.right, env)
        if {a, b} <= {"int", "float", "bool"} and None not in (a, b):
            return "float" if "float" in (a, b) or isinstance(node.op, ast.Div) else "int"
        return a if a == b else None
    return None


def _type_issues(text: str):
    """TYPE001: an operator on literals whose types it does not take; TYPE002: a parameter without annotation."""
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    env, out = {}, []
    numbers = {"int", "float", "bool", "complex"}
    for node in ast.walk(root):
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            env[node.targets[0].id] = _literal_type(node.value, env)
    for node in ast.walk(root):
        if isinstance(node, ast.BinOp):
            a, b = _literal_type(node.left, env), _literal_type(node.right, env)
            same = a == b or {a, b} <= numbers
            repeat = isinstance(node.op, ast.Mult) and "int" in (a, b)
            text_format = isinstance(node.op, ast.Mod) and a == "str"
            if a and b and not same and not repeat and not text_format:
                out.append(("TYPE001", f"{a} {type(node.op).__name__} {b}", node.lineno))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out += [("TYPE002", a.arg, a.lineno) for a in node.args.args if a.annotation is None and a.arg not in ("self", "cls")]
    yield from sorted(out, key=lambda x: (x[2], x[0], x[1]))


def type_issues(texts: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    return _with_rows(texts, key, text_col, _TYPE, _type_issues)


def call_table(texts: DataFrame, file_col: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, calls) of Python sources, from their trees: definitions named file::name, and what they call."""
    out = T.StructType([T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("ref", T.StringType())])

    def rows(text):
        try:
            root = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return
        for f in ast.walk(root):
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield f.name, f.lineno, None
                for c in ast.walk(f):
                    if isinstance(c, ast.Call):
                        ref = c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else None
                        if ref:
                            yield f.name, f.lineno, ref

    all_rows = _with_rows(texts, [file_col], text_col, out, rows)
    me = F.concat(F.col(file_col), F.lit("::"), F.col("name"))
    nodes = all_rows.filter("ref IS NULL").select(me.alias("node_id"), "name", F.col(file_col).alias("file"), "line").distinct()
    return nodes, all_rows.filter("ref IS NOT NULL").select(me.alias("src"), "ref").distinct()


def signature_issues(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """calls (function, args: array of names) against signatures (function, params: array of (name, required)): unknown and missing."""
    rows = calls.join(signatures, "function")
    names = F.transform("params", lambda p: p["name"])
    need = F.transform(F.filter("params", lambda p: p["required"]), lambda p: p["name"])
    return rows.select("function", "args", F.array_except("args", names).alias("unknown"), F.array_except(need, F.col("args")).alias("missing")).filter((F.size("unknown") > 0) | (F.size("missing") > 0))



# Formats, kinds of cells, required facts of a kernel, and magic commands of notebooks.
FORMATS = [(3, 0), (4, 0), (4, 1), (4, 2), (4, 3), (4, 4), (4, 5)]
CELLS = ["code", "markdown", "raw"]
KERNEL = ["name", "language", "display_name"]
CELL_MAGIC = "bash sh script pypy python python2 python3 perl ruby node javascript js html svg latex markdown time timeit capture writefile file prun memit cython rust sql R".split()
LINE_MAGIC = "time timeit prun memit debug pdb load run who whos reset history save store cd pwd ls env set_env system sx automagic matplotlib config precision pprint".split()
_NOTEBOOK = T.StructType([T.StructField("issue", T.StringType()), T.StructField("cell", T.IntegerType())])


def _blank_source(source) -> bool:
    if source is None or isinstance(source, str):
        return not (source or "").strip()
    return isinstance(source, list) and not any(isinstance(x, str) and x.strip() for x in source)


def _magic(source) -> str | None:
    """The magic command that a cell begins with."""
    text = source if isinstance(source, str) else "".join(x for x in source if isinstance(x, str)) if isinstance(source, list) else ""
    first = text.split("\n", 1)[0].strip()
    return first.split()[0] if first.startswith("%") else None


def _notebook_issues(text: str):
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError):
        yield "NB001", None
        return
    whole = isinstance(doc, dict)
    is_int = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if whole:
        minor = doc.get("nbformat_minor")
        if not is_int(doc.get("nbformat")):
            yield "NB003", None
        elif (doc["nbformat"], minor if is_int(minor) else 0) not in FORMATS:
            yield "NB002", None
        if "cells" not in doc:
            yield "NB004", None
        elif not isinstance(doc["cells"], list):
            yield "NB005", None
    else:
        yield "NB006", None
    meta = doc.get("metadata") if whole else None
    if isinstance(meta, dict):
        kernel, info = meta.get("kernelspec"), meta.get("language_info")
        if isinstance(kernel, dict):
            yield from (("NB009", None) for k in KERNEL if k not in kernel)
        else:
            yield ("NB010" if "kernelspec" in meta else "NB011"), None
        if isinstance(info, dict) and "name" not in info:
            yield "NB012", None
    else:
        yield ("NB007" if whole and "metadata" in doc else "NB008"), None
    cells = doc.get("cells") if whole else None
    if cells == []:
        yield "NB013", None
    for i, cell in enumerate(cells if isinstance(cells, list) else ()):
        if not isinstance(cell, dict):
            yield "NB014", i
            continue
        kind = cell.get("cell_type")
        if kind not in CELLS:
            yield ("NB015" if isinstance(kind, str) else "NB016"), i
            continue
        if _blank_source(cell.get("source")):
            yield "NB017", i
        magic = _magic(cell.get("source"))
        if magic and not (magic[2:] in CELL_MAGIC if magic.startswith("%%") else magic[1:] in LINE_MAGIC) and magic != "%%sx":
            yield "NB018", i
        if kind == "code":
            outputs = cell.get("outputs", [])
            if not isinstance(outputs, list):
                yield "NB019", i
            if cell.get("execution_count") is not None and not is_int(cell["execution_count"]):
                yield "NB020", i
            yield from (("NB021", i) for o in (outputs if isinstance(outputs, list) else ()) if isinstance(o, dict) and o.get("output_type") == "error")


def notebook_issues(texts: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    """(key, issue, cell): structural checks of notebook documents, NB001 to NB021; cells count from 0."""
    return _with_rows(texts, key, text_col, _NOTEBOOK, _notebook_issues)


def histograms(texts: DataFrame, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """(name, value, n): how often each expression's first group stands in all texts; what a learner counts."""
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rx), 1).alias("vs")) for name, rx in patterns.items()))
    rows = texts.select(F.explode(each).alias("e")).select("e.name", F.explode("e.vs").alias("value"))
    return rows.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def learned(hist: DataFrame, least: int = 3, confidence: float = 0.7) -> DataFrame:
    """Candidate conventions: the share of each name's commonest value, where it is enough (ties by value)."""
    rows = hist.groupBy("name").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return rows.withColumn("confidence", F.col("n") / F.col("total")).filter((F.col("n") >= least) & (F.col("confidence") >= confidence))


def context_column(flag: Column, key: Sequence[str], back: int, ahead: int) -> Column:
    from pyspark.sql import Window as W

    return F.max(flag.cast("int")).over(W.partitionBy(*key).orderBy("line").rowsBetween(-back, ahead)) == 1
