import random

import pytest
from pyspark.sql import types as T

FIELDS = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
#: Names that operators give to columns of their own.
CLASHING = ["size", "target", "copies", "keep_id", "text_sha256", "key", "bucket", "n", "ref", "raw", "band", "lang_pred", "score", "rejected", "token_ids", "component_id", "chunk", "data", "kind", "stay", "_pid", "own", "__raw", "__nth", "__kept_id", "__stay", "__mix_n", "__mix_text", "__mix_first", "__langid_score", "__langid_lang_pred", "row", "id", "of", "nth", "text_hash", "own_hash", "rate", "first", "all"]
WORDS = {"en": "the of and to in that with river stone light house paper".split(), "fr": "le la les des être élève fenêtre garçon très été".split(), "de": "der die das und über straße größe nicht können".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "en", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Odd and plain documents: nulls in every column, ties, repeats, very long texts."""
    rng = random.Random(3)
    out = []
    for i in range(60):
        lang = rng.choice(list(WORDS))
        t = text(rng, lang, rng.choice([1, 3, 4, 5, 12, 80]))
        out.append((i, t, lang if i % 7 else None, f"s{i % 4}" if i % 9 else None, len(t)))
    base = text(rng, "en", 120).split(" ")
    out += [(100, " ".join(base), "en", "s1", 1), (101, " ".join(base[:-2] + ["xx", "yy"]), "en", "s1", None), (102, "  ".join(base), "en", "s2", 1), (103, " ".join(base).upper(), "en", None, 1)]
    out += [(104, None, "fr", "s1", None), (105, "", "fr", "s1", 0), (106, " \t\n ", None, "s2", 4), (107, "", None, None, None), (None, "a text without an id", "en", "s1", 3), (None, "a text without an id", "en", "s1", 3)]
    out += [(108, text(rng, "de", 30000), "de", "s3", 1), (109, "x" * 300000, "en", "s3", 1), (110, "1234 -- ,,, 99", "en", "s0", 1), (111, "日本語 の文 です", None, "s0", 1), (112, "été ﬁn İx \x1c a\x85b <|endoftext|> c d", "fr", "s0", 1)]
    return out + out[:3] + [out[60]] * 2


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], T.StructType(FIELDS + [T.StructField(c, T.StringType()) for c in CLASHING])).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T.StructType(FIELDS))
