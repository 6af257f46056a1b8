"""Column functions on text: lines, terms, similarity, globs, naming."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of terms and what takes their place, in order of use, and words that are not terms.
SUFFIXES = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "t"), ("ences", "ence"), ("ances", "ance"), ("ments", "ment"), ("ities", "ity"), ("ings", "ing"), ("ives", "ive"), ("ized", "ize"), ("ful", ""), ("ous", ""), ("ive", ""), ("ing", ""), ("ed", ""), ("es", ""), ("ly", ""), ("er", ""), ("s", "")]
STOP_WORDS = """the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would
could should may might must shall can this that these those it its not no yes all any each every both few more most other
some such than too very just also now here there where when which who what how why if then else so up out into over
after before between through during about new""".split()


def lines(text: Column) -> Column:
    """The lines of a text: split at line feeds (a carriage return before one goes), without a last empty line."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def raw_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of at least two bytes."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def stem(term: Column) -> Column:
    """A term with the first suffix of the list that it has replaced, where more than two bytes stand before it."""
    out = F.when(F.lit(False), term)
    for s, instead in SUFFIXES:
        cut = F.substring(term, F.lit(1), F.length(term) - len(s))
        out = out.when(term.endswith(s) & (F.octet_length(term) > len(s) + 2), F.concat(cut, F.lit(instead)) if instead else cut)
    return out.otherwise(term)


def stems(text: Column) -> Column:
    """Stemmed terms without stop words (tested on the stem)."""
    return F.filter(F.transform(raw_terms(text), stem), lambda t: ~t.isin(*STOP_WORDS))


def terms_with_bigrams(text: Column) -> Column:
    """Stems followed by the pairs of neighbours among them, joined by an underscore."""
    def both(one: Column) -> Column:
        n = F.greatest(F.size(one) - 1, F.lit(0))
        return F.concat(one, F.zip_with(F.slice(one, F.lit(1), n), F.slice(one, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b)))

    # a lambda's argument is computed once, however often it stands in the body
    return F.element_at(F.transform(F.array(stems(text)), both), 1)


def word_set(text: Column) -> Column:
    """Different lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets; two empty sets have none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 where a length differs or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def glob_regex(glob: str) -> str:
    """An anchored expression for a glob: ** crosses folders, * and ? stay in one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def glob_column(glob: Column) -> Column:
    """glob_regex() for a column of globs."""
    c = F.regexp_replace(glob, r"([.+()\[\]{}^$|\\])", r"\\$1")
    c = F.replace(F.replace(F.replace(c, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("^"), F.replace(c, F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), r"[\s\-]+", "_"))


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(F.split(snake_case(name), "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def screaming_case(name: Column) -> Column:
    return F.upper(snake_case(name))


def naming_style(name: Column) -> Column:
    """snake, screaming, pascal, camel or mixed."""
    return F.when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "snake").when(name.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "screaming").when(name.rlike("^([A-Z][a-z0-9]*)+$"), "pascal").when(name.rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"), "camel").otherwise("mixed")
